"""Sources of languages with braces, by a scanner of their declarations.

Comments and strings are blanked out at equal length first, so brackets and
names can be matched on what is left.  Declarations are found by patterns,
their parameters and bodies by matching brackets.  What it covers: functions,
methods, constructors, arrow functions bound to a name, classes and interfaces
with their bases, comments above a declaration, and calls with their
arguments.  What it doesn't: macros, generated code and regular-expression
literals that hold brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from quillgraph.parse.documents import record
from quillgraph.parse.rules import Call, detect, detect_dart

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_HIDDEN_PHP = re.compile(_HIDDEN.pattern + r"|(?<!\S)#(?!\[)[^\n]*", re.DOTALL)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words that stand before a bracket without being a call or a declaration.
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "new", "await", "else", "do", "try", "throw", "typeof", "sizeof", "using", "lock", "foreach", "elseif", "isset", "unset", "empty", "require", "include", "super", "assert", "in", "is", "yield", "case"}
_CALLEE = r"(?:new\s+)?[A-Za-z_$][\w$]*(?:\s*(?:\?\.|!\.|\.|->|::)\s*[A-Za-z_$][\w$]*)*"
_CALL = re.compile(rf"(?<![\w$.>])({_CALLEE})\s*(?:<[\w\s,.<>\[\]?]*>)?\s*\(")
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|synchronized|default|readonly|partial|extern|native|external|late|const|factory|covariant)\s+)*"
_TYPE = r"[A-Za-z_][\w.]*(?:\s*<[^(){};=]*?>)?(?:\[\])*\??"

#: For each language: patterns (kind, pattern) of declarations; a pattern ends where the parameters begin.
DECLARATIONS = {
    "go": [("function", r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?=\()"), ("method", r"^func\s*\([^)]*\)\s*(?P<name>\w+)\s*(?=\()")],
    "typescript": [
        ("function", r"(?<![\w.$])function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(){}]*>)?\s*(?=\()"),
        ("arrow_function", r"(?<![\w.$])(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;{}]*?(?:=>[^=;{}]*?)?)?=\s*(?:async\s*)?(?:<[^(){}]*>\s*)?(?=\()"),
        ("method", r"^[ \t]*(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?(?P<name>#?[\w$]+)\s*(?:<[^(){}]*>)?\s*(?=\()"),
    ],
    "php": [("function", r"(?<![\w$>:])function\s+&?(?P<name>\w+)\s*(?=\()")],
    "java": [("method", rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}(?:<[^(){{}}]*>\s*)?(?:(?P<type>{_TYPE})\s+)?(?P<name>\w+)\s*(?=\()")],
    "csharp": [("method", rf"^[ \t]*(?:\[[^\]]*\]\s*)*{_MODIFIERS}(?:(?P<type>{_TYPE})\s+)?(?P<name>\w+)\s*(?:<[^(){{}}]*>)?\s*(?=\()")],
    "dart": [("function", rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODIFIERS}(?:(?P<type>{_TYPE})\s+)?(?:get\s+|set\s+)?(?P<name>\w+(?:\.\w+)?)\s*(?:<[^(){{}}]*>)?\s*(?=\()")],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
_CLASS = re.compile(r"(?<![\w.$@])(?P<what>class|interface|mixin)\s+(?P<name>[A-Za-z_$][\w$]*)(?P<head>[^{};]*)\{")
#: Languages whose classes are taken, and those whose calls can be infrastructure.
WITH_CLASSES = {"typescript", "javascript", "java", "csharp", "dart"}
WITH_INFRA = {"go", "typescript", "javascript", "php"}


def blank(source: str, language: str) -> str:
    """The source with comments and strings as spaces, newlines kept."""
    hidden = _HIDDEN_PHP if language == "php" else _HIDDEN
    return hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(text: str, start: int) -> int:
    """Place of the bracket that closes the one at start; -1 if none does."""
    stack = []
    for at in range(start, len(text)):
        c = text[at]
        if c in _PAIRS:
            stack.append(_PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return at
    return -1


def split_top(text: str, masked: str) -> list[str]:
    """Parts at commas outside brackets, generics included."""
    parts, depth, start = [], 0, 0
    for at, c in enumerate(masked):
        if c in "([{" or c == "<":
            depth += 1
        elif c in ")]}" or (c == ">" and masked[at - 1 : at] not in ("=", "-")):
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            parts.append(text[start:at])
            start = at + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def parameters(text: str, masked: str, language: str) -> list[dict]:
    out = []
    if language == "dart":  # optional and named ones stand in brackets
        flat = re.sub(r"[\[\]{}]", " ", masked)
        text = "".join(" " if c in "[]{}" and m in "[]{}" else c for c, m in zip(text, masked, strict=True))
        masked = flat
    for part in split_top(text, masked):
        part = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*)+", "", part.split("=")[0].strip())
        if language in ("typescript", "javascript"):
            name, _, kind = part.partition(":")
            name = re.sub(r"^(?:public|private|protected|readonly)\s+", "", name.strip()).lstrip(".").rstrip("?")
            out.append({"name": name, "type": kind.strip() or None})
        elif language == "go":
            name, _, kind = part.partition(" ")
            out.append({"name": name, "type": kind.strip() or None})
        else:
            words = re.sub(r"\b(?:final|const|required|ref|out|params|covariant|var)\s+", "", part).split()
            if words:
                out.append({"name": words[-1].split(".")[-1].lstrip("&.") if language != "php" else words[-1].lstrip("&."), "type": " ".join(words[:-1]) or None})
    if language == "go":  # names that share the type of a later one
        for p, q in zip(reversed(out[:-1]), reversed(out[1:]), strict=True):
            p["type"] = p["type"] or q["type"]
    return out


def comment_above(source: str, start: int) -> str | None:
    """Comment lines directly above, without their marks; annotations may stand between."""
    lines = source[:start].split("\n")[:-1]
    while lines and re.match(r"^\s*(?:@\w+.*|\[[^\]]*\])\s*$", lines[-1]):
        lines.pop()
    found = []
    while lines and re.match(r"^\s*(?://|/\*|\*|#(?!\[))|.*\*/\s*$", lines[-1]):
        found.append(lines.pop())
    text = "\n".join(re.sub(r"^\s*(?:/\*\*?|\*(?!/)|///?|#)\s?|\s*\*/\s*$", "", line).rstrip() for line in reversed(found)).strip()
    return text or None


def _argument(text: str) -> str | None:
    """Text of a literal, static parts of a template, items of a list, a variable as ``$name``."""
    text = text.strip()
    if re.fullmatch(r"'[^']*'|\"[^\"]*\"", text, re.DOTALL):
        return text[1:-1] or None
    if text.startswith("`") and text.endswith("`"):
        return "*".join(x for x in re.split(r"\$\{[^}]*\}", text[1:-1]) if x) or text[1:-1] or None
    if text.startswith("[") and text.endswith("]"):
        return ",".join(v for x in text[1:-1].split(",") if (v := _argument(x))) or None
    if re.fullmatch(r"\$?[A-Za-z_]\w*", text):
        return "$" + text.lstrip("$")
    return None


class Scanned:
    """A source with its blanked text and line starts."""

    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.masked = blank(source, language)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def calls(self, low: int, high: int) -> list[tuple[int, Call]]:
        out = []
        for m in _CALL.finditer(self.masked, low, high):
            name = re.sub(r"\s*(\?\.|!\.|\.|->|::)\s*", r"\1", re.sub(r"^new\s+", "new ", m[1]))
            if name.split(".")[-1] in _WORDS and "." not in name:
                continue
            end = closing(self.masked, m.end() - 1)
            inner = (m.end(), end if end > 0 else m.end())
            args = [_argument(x) for x in split_top(self.source[slice(*inner)], self.masked[slice(*inner)]) if not x.startswith("...")]
            out.append((m.start(), Call(name, self.line(m.start()), args)))
        return out

    def body(self, after: int) -> tuple[int, int] | None:
        """Range of the body behind the parameters: a block, or an expression behind an arrow; None if there is none."""
        head = re.compile(r"[^{};=]*?(?:(=>)\s*(\{)?|(\{))", re.DOTALL).match(self.masked, after)
        if not head:
            return None
        if head[2] or head[3]:
            end = closing(self.masked, head.end() - 1)
        else:
            stop = re.compile(r"[;\n]").search(self.masked, head.end())
            end = stop.start() if stop else len(self.masked)
        return (head.end(), end if end > 0 else len(self.masked))


def _bases(head: str, language: str) -> list[str]:
    if language == "csharp":
        _, _, named = head.partition(":")
        named = named.split(" where ")[0]
    else:
        named = " , ".join(re.findall(r"(?:extends|implements|with|on)\s+(.*?)(?=\b(?:extends|implements|with|on)\b|$)", head, re.DOTALL))
    return [re.sub(r"\s+", " ", x) for x in split_top(named, named)]


def parse_braces(path: str, source: str, language: str) -> dict:
    s = Scanned(source, language)
    symbols, spans = [], []
    for kind, pattern in DECLARATIONS[language]:
        for m in re.finditer(pattern, s.masked, re.MULTILINE):
            name = m["name"]
            returned = m.groupdict().get("type")
            if name in _WORDS or returned in ("return", "new", "else", "await", "throw", "case", "in") or any(m.end() == e for _, e in spans):
                continue
            end = closing(s.masked, m.end())
            body = s.body(end + 1) if end > 0 else None
            tail = re.compile(r"\s*(:\s*[^={};]+?)?\s*(?:=>|\{|;|$)").match(s.masked, end + 1) if end > 0 else None
            declared = language in ("java", "csharp", "dart") and returned is not None and end > 0 and re.compile(r"\s*(?:throws[^;{]*)?;").match(s.masked, end + 1)
            if body is None and not declared:
                continue
            if kind == "arrow_function" and not (tail and "=>" in s.masked[end + 1 : body[0]]):
                continue
            if kind == "method" and language in ("typescript", "javascript") and "=>" in s.masked[end + 1 : body[0]]:
                continue
            if language in ("typescript", "javascript", "php") and tail and tail[1]:
                returned = tail[1].lstrip(":").strip()
            if language == "go":
                returned = s.masked[end + 1 : body[0] - 1].strip() or None if body else None
            spans.append((m.start(), m.end()))
            low, high = body or (end, end)
            name_at = m.start("name")
            symbols.append((m.start(), {
                "name": name, "kind": kind, "params": parameters(source[m.end() + 1 : end], s.masked[m.end() + 1 : end], language), "return_type": returned, "docstring": comment_above(source, source.rfind("\n", 0, name_at) + 1),
                "calls": [{"name": c.name, "line": c.line} for _, c in s.calls(low, high)] if language not in ("java",) else [], "start_line": s.line(name_at), "end_line": s.line(high),
            }))
    symbols.sort(key=lambda x: x[0])
    classes = []
    for m in _CLASS.finditer(s.masked):
        end = closing(s.masked, m.end() - 1)
        end = end if end > 0 else len(source)
        inside = [x for at, x in symbols if m.end() <= at < end]
        for x in inside:
            x["kind"] = "method" if x["kind"] == "function" else x["kind"]
        if language in WITH_CLASSES:
            own = [x["name"] for x in inside if x["kind"] == "method"]
            classes.append({"name": m["name"], "bases": _bases(m["head"], language), "methods": own, "docstring": comment_above(source, source.rfind("\n", 0, m.start()) + 1), "start_line": s.line(m.start()), "end_line": s.line(end)})
    found = [c for _, c in s.calls(0, len(source))]
    if language == "dart":
        infra = detect_dart(sorted(found + _chained(s), key=lambda c: c.line), [(m[0], s.line(m.start())) for m in re.finditer(r"[A-Za-z_]\w*", s.masked)])
    else:
        infra = detect(found) if language in WITH_INFRA else []
    errors = [f"Unbalanced brackets near line {s.line(len(source))}"] if s.masked.count("{") != s.masked.count("}") else []
    return record(path, language, symbols=[x for _, x in symbols], classes=classes, infra=infra, errors=errors)


def _chained(s: Scanned) -> list[Call]:
    """Calls whose callee continues the result of a call, as in ``a.b(x).c(y)``: named by what follows the bracket."""
    out = []
    for m in re.finditer(r"\)\s*((?:[?!]?\.\s*\w+\s*)+)\(", s.masked):
        end = closing(s.masked, m.end() - 1)
        inner = (m.end(), end if end > 0 else m.end())
        out.append(Call(re.sub(r"[\s?!]", "", m[1]), s.line(m.end() - 1), [_argument(x) for x in split_top(s.source[slice(*inner)], s.masked[slice(*inner)])]))
    return out
