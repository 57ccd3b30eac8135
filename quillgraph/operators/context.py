"""Context under a token budget: pack manifests, snippets, artifacts, task ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalar as S


def budget_prefix(ranked: DataFrame, max_tokens: int, max_items: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """The results in rank order (of each group, if ``by`` names any) up to, and without, the first that would exceed the budget.

    At most ``max_items`` of a group are kept, so that is what the sum goes over.
    """
    costed = ranked.where(F.col("rank") <= max_items).withColumn("tokens", S.estimate_tokens(F.col("document")))
    used = F.sum("tokens").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return costed.withColumn("used", used).where(F.col("used") <= max_tokens)


def manifest(kept: DataFrame, workspace: str) -> DataFrame:
    """Manifest rows (id, type, source, reason, tokens) of kept results."""
    service = F.coalesce("service", F.lit(workspace))
    symbol = F.coalesce("name", F.lit("")) != ""
    shown = F.when(symbol, F.concat(F.lit("symbol:"), service, F.lit("/"), "name")).otherwise(F.concat(F.lit("file:"), "file"))
    reason = F.concat(F.lit("Score "), F.format_number("score", 3), F.lit(" via "), "via", F.lit(" search"))
    return kept.select("rank", shown.alias("id"), F.when(symbol, "symbol_context").otherwise("file_capsule").alias("type"), F.col("file").alias("source"), reason.alias("reason"), "tokens")


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), text and tokens of each line."""
    return files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text", S.estimate_tokens(F.concat("text", F.lit("\n"))).alias("tokens"))


def snippet(rows: DataFrame, max_tokens: int, start: int = 1, end: int | None = None, most: int = 80) -> DataFrame:
    """Lines of each file from start, as many as the budget and the line limit allow."""
    last = start + most - 1 if end is None else min(end, start + most - 1)
    inside = rows.where(F.col("line").between(start, last))
    used = F.sum("tokens").over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("used", used).where(F.col("used") <= max_tokens)


def section_fold(sections: Column, max_tokens: int) -> Column:
    """Sections (array of struct(id, tokens)) in order: unreadable ones (null tokens) are skipped, the first that doesn't fit ends it."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["full"] & x["tokens"].isNotNull() & (acc["used"] + x["tokens"] <= max_tokens)
        over = x["tokens"].isNotNull() & (acc["used"] + x["tokens"] > max_tokens)
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), (acc["full"] | over).alias("full"), F.when(fits, F.array_append(acc["ids"], x["id"])).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(sections, start, step)


def allowed_source(manifest_rows: Column, source: Column) -> Column:
    """Whether a source is named in a manifest (array of struct(id, source)): by source, id, or the end of an id."""
    return F.exists(manifest_rows, lambda m: (m["source"] == source) | (m["id"] == source) | F.endswith(m["id"], F.concat(F.lit("/"), source)))


def artifacts(rows: DataFrame) -> DataFrame:
    """id, kind, summary, size and token estimate of (id, kind, content)."""
    return rows.select("id", "kind", S.artifact_summary(F.col("kind"), F.col("content")).alias("summary"), F.octet_length("content").alias("size_bytes"), S.estimate_byte_tokens(F.col("content")).alias("tokens"))


def excerpt(rows: DataFrame, start: int, end: int, max_tokens: int = 1500) -> DataFrame:
    """Lines of artifacts, clamped and cut to the budget with a hint where it goes on."""
    text = S.excerpt(F.col("content"), F.lit(start), F.lit(end))
    most = max_tokens * S.CHARS_PER_TOKEN
    total = F.size(F.split("content", "\n"))
    cut = F.char_length("excerpt") > most
    out = rows.select("id", text.alias("excerpt"), F.greatest(F.lit(start), F.lit(1)).alias("start_line"), F.least(F.lit(end), total).alias("end_line"), total.alias("total_lines"))
    return out.withColumn("truncated", cut).withColumn("excerpt", F.when(cut, F.concat(F.left("excerpt", F.lit(most)), F.lit("\n… [continue from a later line]"))).otherwise(F.col("excerpt")))


def ledger(updates: DataFrame) -> DataFrame:
    """State of each task from its updates (task, seq, objective, state, constraints, decisions, files, commands, questions, next).

    Constraints, files and questions are kept once in order, decisions and
    commands are appended, next actions and single values are replaced by the
    newest. One aggregation, in the order of seq.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "objective", "state", "constraints", "decisions", "files", "commands", "questions", "next")))
    rows = updates.groupBy("task").agg(ordered.alias("u"))
    every = lambda field: F.flatten(F.filter(F.transform("u", lambda x: x[field]), lambda x: x.isNotNull()))
    latest = lambda field: F.try_element_at(F.filter(F.transform("u", lambda x: x[field]), lambda x: x.isNotNull()), F.lit(-1))
    return rows.select("task", latest("objective").alias("objective"), latest("state").alias("state"), *(F.array_distinct(every(c)).alias(c) for c in ("constraints", "files", "questions")), *(every(c).alias(c) for c in ("decisions", "commands")), latest("next").alias("next"))


def compact_ledger(state: DataFrame) -> DataFrame:
    return state.select("task", "objective", "state", "constraints", "files", "questions", "next", F.size("decisions").alias("decision_count"), F.size("commands").alias("command_count"))


def ledger_text() -> Column:
    listed = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("Objective: "), F.coalesce("objective", F.lit(""))), F.concat(F.lit("State: "), F.coalesce("state", F.lit(""))), listed("Constraints: ", "constraints"), listed("Touched: ", "files"), listed("Next: ", "next"))


def repo_capsule(services: DataFrame, workspace: str, limit: int = 10) -> DataFrame:
    """One text that lists the first services by name."""
    first = services.orderBy("name").limit(limit)
    shown = F.concat(F.lit("  - "), "name", F.when(F.col("language").isNotNull(), F.concat(F.lit(" ["), "language", F.lit("]"))).otherwise(""), F.when(F.col("path").isNotNull(), F.concat(F.lit(" @ "), "path")).otherwise(""))
    listed = first.agg(F.array_sort(F.collect_list(shown)).alias("l"))
    return listed.select(F.concat_ws("\n", F.lit(f"Workspace: {workspace}"), F.concat(F.lit("Services ("), F.size("l").cast("string"), F.lit("):")), F.array_join("l", "\n")).alias("capsule"))


def redact(rows: DataFrame, debug: bool, absolute: list[str]) -> DataFrame:
    """Without the columns that hold absolute paths, unless debugging."""
    return rows if debug else rows.drop(*absolute)


def _artifact_id() -> Column:
    return F.concat(F.lit("artifact_"), F.lower(F.hex(F.xxhash64("id", "content"))))


def limit_output(text: DataFrame, max_input: int, reserved: int, max_output: int = 1_500, stored: bool = False) -> DataFrame:
    """Rows of (id, content) with the action: passed, trimmed, or offloaded.

    A text that is cut after a key of a JSON object is closed, if that makes
    it whole again; else the cut is marked.  What is to be offloaded is named
    with its summary if it is ``stored``, else cut and marked.
    """
    rows = text.select("id", "content", S.budget_action(S.estimate_tokens(F.col("content")), max_input, reserved, max_output).alias("action"))
    cut_at = F.left("content", F.lit(min(max_output, max_input - reserved) * S.CHARS_PER_TOKEN))
    closed = F.concat(cut_at, F.lit('"__truncated__"}'))
    # The parser stops behind the first value ("12 and more" is 12 to it); only text that is one value as a whole can stand both in an array and in an object.
    inside = [F.try_parse_json(F.concat(F.lit(a), closed, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"x":', "}"))]
    trimmed = F.when(inside[0] & inside[1], closed).otherwise(F.concat(cut_at, F.lit("… [TRUNCATED]")))
    if stored:
        rest = F.to_json(F.struct(_artifact_id().alias("artifact"), S.artifact_summary(F.lit("document"), F.col("content")).alias("summary")))
    else:
        rest = F.concat(F.left("content", F.lit(max_output * S.CHARS_PER_TOKEN)), F.lit("… [OFFLOAD REQUIRED]"))
    return rows.select("id", "action", F.when(F.col("action") == "pass", F.col("content")).when(F.col("action") == "trim", trimmed).otherwise(rest).alias("content"))


def offloaded(text: DataFrame, max_input: int, reserved: int, max_output: int = 1_500) -> DataFrame:
    """The artifacts (id, kind, content) that ``limit_output`` names."""
    action = S.budget_action(S.estimate_tokens(F.col("content")), max_input, reserved, max_output)
    return text.where(action == "offload").select(_artifact_id().alias("id"), F.lit("document").alias("kind"), "content")
