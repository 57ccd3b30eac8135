"""Python sources, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import warnings

from quillgraph.parse.documents import record
from quillgraph.parse.rules import Call, detect


def _value(node: ast.AST) -> str | None:
    """Text of a literal, the names in a list, a variable as ``$name``, the key of an environment lookup."""
    match node:
        case ast.Constant(value=str(text)):
            return text or None
        case ast.JoinedStr(values=parts):
            return "*".join(p.value for p in parts if isinstance(p, ast.Constant)) or None
        case ast.List(elts=items):
            return ",".join(v for x in items if (v := _value(x))) or None
        case ast.Call(func=function, args=[first, *_]) if any(k in ast.unparse(function) for k in ("getenv", "environ.get")):
            return _value(first)
        case ast.Name() | ast.Attribute():
            return f"${ast.unparse(node)}"
    return None


def _call(node: ast.Call) -> Call:
    plain = [a for a in node.args if not isinstance(a, ast.Starred)]
    return Call(ast.unparse(node.func), node.lineno, [_value(a) for a in plain], {k.arg: _value(k.value) for k in node.keywords if k.arg})


def _preorder(node: ast.AST):
    yield node
    for child in ast.iter_child_nodes(node):
        yield from _preorder(child)


def _comment_above(lines: list[str], line: int) -> str | None:
    found = []
    while line > 1 and lines[line - 2].strip().startswith("#"):
        found.append(lines[line - 2].strip().lstrip("#").strip())
        line -= 1
    return "\n".join(reversed(found)).strip() or None


def _parameters(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    a = node.args
    every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    return [{"name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else None} for p in every]


def parse_python(path: str, source: str) -> dict:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return record(path, "python", errors=[f"Syntax error: {error}"[:120]])
    lines = source.splitlines()
    nodes = list(_preorder(tree))
    methods = {id(f) for c in nodes if isinstance(c, ast.ClassDef) for f in c.body}
    symbols, classes = [], []
    for node in nodes:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else 0
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = [c for statement in node.body for c in _preorder(statement) if isinstance(c, ast.Call)]
            symbols.append({
                "name": node.name, "kind": "method" if id(node) in methods else "function", "params": _parameters(node), "return_type": ast.unparse(node.returns) if node.returns else None,
                "docstring": _comment_above(lines, first) or ast.get_docstring(node), "calls": [{"name": ast.unparse(c.func), "line": c.lineno} for c in inner], "start_line": node.lineno, "end_line": node.end_lineno,
            })
        elif isinstance(node, ast.ClassDef):
            own = [f.name for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
            classes.append({"name": node.name, "bases": [ast.unparse(b) for b in node.bases], "methods": own, "docstring": _comment_above(lines, first) or ast.get_docstring(node), "start_line": node.lineno, "end_line": node.end_lineno})
    return record(path, "python", symbols=symbols, classes=classes, infra=detect([_call(n) for n in nodes if isinstance(n, ast.Call)]))
