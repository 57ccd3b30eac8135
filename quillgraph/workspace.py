"""Driver-side state: repositories, manifests, patches, rendering. Small by nature; nothing here touches data."""

from __future__ import annotations

import difflib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

import yaml

from quillgraph.sources.git import git, head


@dataclass
class Repository:
    id: str
    path: str
    head: str | None = None


@dataclass
class Manifest:
    id: str
    repositories: list[Repository] = field(default_factory=list)

    def to_yaml(self) -> str:
        rows = sorted((asdict(r) for r in self.repositories), key=lambda r: r["id"])
        return yaml.safe_dump({"id": self.id, "repositories": rows}, sort_keys=False)

    @classmethod
    def from_yaml(cls, text: str) -> Manifest:
        raw = yaml.safe_load(text) or {}
        return cls(str(raw.get("id", "default")), [Repository(**r) for r in raw.get("repositories", [])])


def repository_id(path: str) -> str:
    """Package name without its scope, else the remote's last part, else the folder's name."""
    package = Path(path, "package.json")
    if package.is_file():
        try:
            name = json.loads(package.read_text()).get("name")
            if name:
                return re.sub(r"^@[^/]+/", "", name)
        except ValueError:
            pass
    remote = git(path, "config", "--get", "remote.origin.url")
    if remote:
        return re.sub(r"\.git$", "", remote.rstrip("/").split("/")[-1].split(":")[-1])
    return Path(path).resolve().name


def detect(path: str) -> Repository:
    top = git(path, "rev-parse", "--show-toplevel") or path
    return Repository(repository_id(top), str(Path(top).resolve()), head(top))


def resolve_source(source: str, root: str | None = None) -> Path | None:
    """First existing one of: the path itself, below the root, below the working directory."""
    options = [Path(source)] if Path(source).is_absolute() else [Path(x, source) for x in (root, ".") if x]
    return next((p for p in options if p.is_file()), None)


def patch(original: str, copy: str, names: list[str]) -> str:
    """Unified diff of copied files against the originals."""
    out: list[str] = []
    for name in names:
        sides = [p.read_text().splitlines(keepends=True) if (p := Path(base, name)).is_file() else [] for base in (original, copy)]
        out += difflib.unified_diff(*sides, f"a/{name}", f"b/{name}")
    return "".join(x if x.endswith("\n") else f"{x}\n" for x in out)


def patch_lines(diff: str) -> tuple[int, int]:
    lines = diff.splitlines()
    return tuple(sum(x.startswith(s) and not x.startswith(s * 3) for x in lines) for s in "+-")


def render_pack(pack: dict) -> str:
    """Markdown of a context pack."""
    parts = [f"# Context: {pack['task']}", f"Mode: {pack['mode']} | tokens: {pack['estimated_tokens']}", "## Manifest"]
    parts += [f"- {m['id']} ({m['type']}, {m['tokens']} tokens): {m['reason']}" for m in pack["manifest"]]
    for s in pack["sections"]:
        parts += [f"## {s['title']}", s["content"]]
    return "\n\n".join(parts)
