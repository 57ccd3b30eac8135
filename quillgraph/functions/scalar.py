"""Scalar functions as Catalyst expressions: none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.schemas import LANGUAGES

CHARS_PER_TOKEN = 4
RRF_K = 60


def content_hash(content: Column) -> Column:
    """First 16 characters of the SHA-256 of a text."""
    return F.left(F.sha2(content, 256), F.lit(16))


def language_of(path: Column) -> Column:
    """Language by the lower-cased extension; null for unknown ones."""
    extension = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), F.when(extension.isin(*LANGUAGES), extension))


def rrf(rank: Column) -> Column:
    """Reciprocal-rank score of a 1-based rank."""
    return F.lit(1.0) / (rank + RRF_K)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which token estimates are counted: characters beyond U+FFFF count twice."""
    return F.char_length(text) + F.size(F.regexp_extract_all(text, F.lit(r"[\x{10000}-\x{10FFFF}]"), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN)


def estimate_byte_tokens(text: Column) -> Column:
    """Estimate of stored artifacts, which count bytes."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN)


def budget_action(tokens: Column, max_input: int, reserved: int, max_output: int = 1500) -> Column:
    """pass up to the allowance, trim up to ten times as much, else offload."""
    allowed = min(max_output, max_input - reserved)
    return F.when(tokens <= allowed, "pass").when(tokens <= allowed * 10, "trim").otherwise("offload")


def trim_to_budget(text: Column, max_tokens: int) -> Column:
    """At most the characters of max_tokens, with a mark if cut."""
    most = max_tokens * CHARS_PER_TOKEN
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("\n… [TRIMMED TO BUDGET]")))


def fits_budget(text: Column, max_input: int, reserved: int) -> Column:
    return estimate_tokens(text) <= max_input - reserved


def escape_pattern(text: Column) -> Column:
    r"""Backslash before each character that is special in a pattern."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def call_confidence(same_file: Column, callee: Column) -> Column:
    return F.when(same_file, 0.95).when(F.contains(callee, F.lit(".")), 0.85).otherwise(0.7).cast("double")


def call_reason(same_file: Column, callee: Column) -> Column:
    return F.when(same_file, "same_file").when(F.contains(callee, F.lit(".")), "method_call").otherwise("name_match")


def signature(name: Column, params: Column, return_type: Column) -> Column:
    """``name(a: T, b) → R`` from params array<struct<name, type>>."""
    shown = F.transform(params, lambda p: F.when(F.coalesce(p["type"], F.lit("")) != "", F.concat(p["name"], F.lit(": "), p["type"])).otherwise(p["name"]))
    returned = F.when(F.coalesce(return_type, F.lit("")) != "", F.concat(F.lit(" → "), return_type)).otherwise("")
    return F.concat(name, F.lit("("), F.array_join(shown, ", "), F.lit(")"), returned)


def normalize_path(url: Column) -> Column:
    """Lower-cased path of a URL or path: no query, no trailing slashes, "/" if nothing is left."""
    path = F.when(url.rlike("^https?://"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).otherwise(url)
    return F.coalesce(F.nullif(F.regexp_replace(F.split_part(F.lower(path), F.lit("?"), F.lit(1)), "/+$", ""), F.lit("")), F.lit("/"))


def route_pattern(route: Column) -> Column:
    """Anchored pattern of a normalised route template with ``:name`` or ``{name}`` places."""
    escaped = F.regexp_replace(route, r"([.*+?^$()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r":\w+", "[^/]+"), r"\{[^}]+\}", "[^/]+"), F.lit("$"))


def route_score(caller: Column, route: Column) -> Column:
    """3 equal, 2 by template, 1 by prefix, 0 none, for normalised paths; a bare route never matches."""
    bare = route.isin("<path>", "", "/")
    return F.when(bare, 0).when(caller == route, 3).when(route.rlike(r":|\{") & F.rlike(caller, route_pattern(route)), 2).when(F.startswith(caller, route), 1).otherwise(0)


def change_risk_score(callers: Column, infra: Column, deleted: Column) -> Column:
    return F.when(deleted, 40).otherwise(0) + F.when(callers > 10, 30).when(callers > 3, 15).when(callers > 0, 5).otherwise(0) + F.when(infra, 20).otherwise(0)


def change_risk_level(score: Column) -> Column:
    return F.when(score >= 60, "critical").when(score >= 40, "high").when(score >= 15, "medium").otherwise("low")


def change_risk_factors(callers: Column, infra: Column, deleted: Column) -> Column:
    named = lambda what: F.concat(F.lit(f"{what}_fan_in("), callers.cast("string"), F.lit("_callers)"))
    fan = F.when(callers > 10, named("high")).when(callers > 3, named("moderate")).when(callers > 0, named("low"))
    return F.array_compact(F.array(F.when(deleted, "file_deleted"), fan, F.when(infra, "touches_infrastructure")))


def clean_docstring(raw: Column) -> Column:
    """Comment marks, quotes and margins removed from each line; null if nothing is left."""
    bare = F.regexp_replace(raw, r"^\s*(?:/\*\*?|\"\"\"|''')|(?:\*/|\"\"\"|''')\s*$", "")
    lines = F.transform(F.split(bare, "\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s*(?:\*|///?|#)\s?", "")))
    return F.nullif(F.trim(F.array_join(F.filter(lines, lambda line: line != ""), "\n")), F.lit(""))


def slug(query: Column, most: int = 60) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def since(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def log_summary(content: Column) -> Column:
    """Summary of a test log: its first five failing lines."""
    lines = F.split(content, "\n")
    failing = F.slice(F.filter(lines, lambda x: x.rlike("FAIL|Error:|✗|✕|× ")), 1, 5)
    head = F.concat(F.lit("Test log: "), F.size(lines).cast("string"), F.lit(" lines"))
    return F.when(F.size(failing) == 0, F.concat(head, F.lit(", no failures detected"))).otherwise(F.concat(head, F.lit(". Failures: "), F.array_join(F.transform(failing, stripped), " | ")))


def diff_summary(content: Column) -> Column:
    counts = [F.regexp_count(content, F.lit(p)).cast("string") for p in (r"(?m)^diff --git", r"(?m)^\+[^+]", r"(?m)^-[^-]")]
    return F.concat(F.lit("Diff: "), counts[0], F.lit(" file(s) changed, +"), counts[1], F.lit(" -"), counts[2], F.lit(" lines"))


def terminal_summary(content: Column) -> Column:
    lines = F.split(content, "\n")
    errors = F.slice(F.filter(lines, lambda x: x.rlike("error|Error|ERROR|fail|FAIL")), 1, 3)
    n = F.size(lines).cast("string")
    return F.when(F.size(errors) > 0, F.concat(F.lit("Terminal output ("), n, F.lit(" lines). Errors: "), F.array_join(F.transform(errors, stripped), " | "))).otherwise(F.concat(F.lit("Terminal output: "), n, F.lit(" lines")))


def artifact_summary(kind: Column, content: Column) -> Column:
    other = F.concat(F.size(F.split(content, "\n")).cast("string"), F.lit(" lines of "), kind)
    return F.when(kind == "test_log", log_summary(content)).when(kind == "diff", diff_summary(content)).when(kind == "terminal_output", terminal_summary(content)).otherwise(other)


def excerpt(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, clamped), joined."""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def function_chunk(language: Column, sig: Column, file: Column, start: Column, end: Column, calls: Column, infra: Column) -> Column:
    """Text of a function's search chunk; calls and infra are arrays of strings."""
    part = lambda head, values, sep: F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(values, sep)))
    return F.concat_ws("\n", F.concat(F.lit("["), language, F.lit("] "), sig), F.concat(F.lit("File: "), file), F.concat(F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string")), part("Calls: ", calls, ", "), part("Infrastructure: ", infra, "; "))


def class_chunk(language: Column, name: Column, bases: Column, file: Column, start: Column, end: Column, methods: Column, docstring: Column) -> Column:
    part = lambda head, values: F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(values, ", ")))
    doc = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit("Doc: "), F.left(docstring, F.lit(200))))
    return F.concat_ws("\n", F.concat(F.lit("["), language, F.lit("] class "), name), part("Inherits: ", bases), F.concat(F.lit("File: "), file), F.concat(F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string")), part("Methods: ", methods), doc)


def keyword_document(label: Column, name: Column, file: Column, docstring: Column) -> Column:
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.concat_ws("\n", F.concat(F.lit("["), label, F.lit("] "), name), F.when(filled(file), F.concat(F.lit("File: "), file)), F.when(filled(docstring), F.concat(F.lit("Doc: "), F.left(docstring, F.lit(200)))))


def is_interface(name: Column, language: Column) -> Column:
    return language.isin("csharp", "typescript") & name.rlike("^I[A-Z]")


#: Patterns that deny a shell command, then those that ask first; the first match decides.
DENY = [
    (r"\brm\s+(-[^\s]*f[^\s]*)?\s+-[^\s]*r.*(\/\s*$|\/\*|\s+\/$|\s+\/\*)", "rm -rf on root/filesystem"),
    (r"\brm\s+-rf\s+(\/\s*$|\/\*)", "rm -rf / or /*"),
    (r"\bdd\s+if=", "dd disk write"),
    (r"\bmkfs\b", "mkfs — format filesystem"),
    (r"\bgit\s+push\s+.*(-f|--force)\s+.*\b(master|main)\b", "git force-push to master/main"),
    (r"\bgit\s+push\s+.*\b(master|main)\b.*(-f|--force)", "git force-push to master/main"),
    (r"\bDROP\s+(DATABASE|SCHEMA)\s+\w+", "DROP DATABASE/SCHEMA"),
]
ASK = [
    (r"\bdocker\s+(rm|rmi|system\s+prune|volume\s+rm)", "docker destructive operation"),
    (r"(?<!\bdocker\s)\brm\s+", "file deletion (rm)"),
    (r"\bgit\s+reset\s+--hard\b", "git reset --hard"),
    (r"\bgit\s+reset\b", "git reset (may lose changes)"),
    (r"\bgit\s+stash\s+drop\b", "git stash drop (loses stashed changes)"),
    (r"\bgit\s+clean\s+(-[^\s]*[fd])", "git clean -fd (removes untracked files)"),
    (r"\bgit\s+push\s+.*(-f|--force)", "git force-push"),
    (r"\bgit\s+push\s+(-u\s+)?origin\s+(master|main)\b", "direct push to master/main"),
    (r"\bgit\s+checkout\s+(-f|--force)", "git checkout --force"),
    (r"\bgit\s+commit\s+--amend\b", "git commit --amend (rewrites history)"),
    (r"\bgit\s+rebase\b", "git rebase (rewrites history)"),
    (r"\bDROP\s+TABLE\b", "DROP TABLE"),
    (r"\bTRUNCATE\s+TABLE\b", "TRUNCATE TABLE"),
    (r"\b(curl|wget)\b.*\|\s*(bash|sh|zsh)", "pipe remote content to shell"),
    (r"\bkill\s+-9\b", "kill -9 (SIGKILL)"),
    (r"\bchmod\s+(-R\s+)?777\b", "chmod 777 (world-writable)"),
    (r"\bgit\s+branch\s+(-D|-d)\b", "git branch delete"),
    (r"\bgit\s+push\s+origin\s+--delete\b", "git push --delete (remote branch delete)"),
    (r"\bnpm\s+(unpublish|deprecate)\b", "npm unpublish/deprecate"),
    (r"\b>\s*\/[^\s]+", "redirect overwrite to absolute path"),
]
#: Conventional commit messages, those that skip the check, protected branches.
COMMIT = r"^(feat|fix|chore|docs|refactor|test|ci|perf|style|revert)(\([a-z0-9\-]+\))?: .{1,100}$"
COMMIT_SKIPPED = r"^(Merge|Revert|fixup!|squash!|Rebase)"
PROTECTED_BRANCH = r"^(master|main)$"


def command_decision(command: Column) -> Column:
    """struct(decision, reason) of a shell command."""
    out = None
    for decision, rules in (("deny", DENY), ("ask", ASK)):
        for pattern, label in rules:
            verdict = F.struct(F.lit(decision).alias("decision"), F.lit(label).alias("reason"))
            hit = command.rlike(f"(?i){pattern}")
            out = F.when(hit, verdict) if out is None else out.when(hit, verdict)
    return out.otherwise(F.struct(F.lit("allow").alias("decision"), F.lit("safe").alias("reason")))


def is_conventional_commit(message: Column) -> Column:
    return message.rlike(COMMIT_SKIPPED) | F.split_part(message, F.lit("\n"), F.lit(1)).rlike(COMMIT)


def is_protected_branch(branch: Column) -> Column:
    return branch.rlike(PROTECTED_BRANCH)
