"""Sync from the command line, and hooks that run it after a merge or a push.

    python -m quillgraph.sync PATH --service NAME --folder KEPT [--force]
    python -m quillgraph.sync PATH --service NAME --folder KEPT --install
"""

from __future__ import annotations

import argparse
import shlex
import sys
from pathlib import Path

from quillgraph.sources import git

HOOKS = ("post-merge", "post-push")
MARK = "# quillgraph sync"


def hook_line(path: str, service: str, folder: str) -> str:
    command = [sys.executable, "-m", "quillgraph.sync", path, "--service", service, "--folder", folder]
    return f"{shlex.join(command)} >/dev/null 2>&1 & {MARK}"


def install(path: str, service: str, folder: str) -> list[str]:
    """Add the sync to the repository's hooks, beside what they do already; returns the files."""
    where = git.git(path, "rev-parse", "--git-path", "hooks")
    if where is None:
        raise ValueError(f"{path} isn't a repository")
    hooks = Path(path, where)
    hooks.mkdir(parents=True, exist_ok=True)
    files = []
    for name in HOOKS:
        file = hooks / name
        lines = file.read_text().splitlines() if file.exists() else ["#!/bin/sh"]
        lines = [x for x in lines if not x.endswith(MARK)] + [hook_line(path, service, folder)]
        file.write_text("\n".join(lines) + "\n")
        file.chmod(0o755)
        files.append(str(file))
    return files


def report(job: dict) -> str:
    files = job["phases"]["filesystem"]
    return f"sync {job['status']} | service={job['service']} total={files['total']} changed={files['changed']} skipped={files['skipped']} deleted={files['deleted']} | {job['summary']}"


def main(arguments: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(description="Index a source tree.")
    parser.add_argument("path")
    parser.add_argument("--service")
    parser.add_argument("--folder", required=True)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--install", action="store_true")
    given = parser.parse_args(arguments)
    service = given.service or Path(given.path).resolve().name
    if given.install:
        return "\n".join(install(given.path, service, given.folder))
    from pyspark.sql import SparkSession

    from quillgraph.api import KnowledgeBase

    return report(KnowledgeBase(SparkSession.builder.getOrCreate(), given.folder).sync(given.path, service, given.force))


if __name__ == "__main__":
    print(main())
