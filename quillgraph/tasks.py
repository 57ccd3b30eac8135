"""Task tools: ledgers, artifacts and isolated task workspaces.

A ledger is the fold of its updates, which are only ever appended, so two
writers don't overwrite each other.  Artifacts are rows by id.  A task
workspace is a folder with copies of a few files, whose difference from the
originals is the task's patch.
"""

from __future__ import annotations

import json
import shutil
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import workspace
from quillgraph.operators import context

UPDATES = "task string, seq long, objective string, state string, constraints array<string>, decisions array<string>, files array<string>, commands array<string>, questions array<string>, next array<string>"
ARTIFACTS = "id string, kind string, content string"
PACKS = "id string, task string, content string"


class TaskStore:
    """Ledger updates and artifacts as Parquet below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def _append(self, name: str, row: dict, schema: str) -> None:
        names = [x.split()[0] for x in schema.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def open(self, objective: str, constraints: list[str] | None = None) -> str:
        task = f"task_{uuid.uuid4().hex[:8]}"
        self.update(task, objective=objective, state="open", constraints=constraints or [])
        return task

    def update(self, task: str, **fields: object) -> None:
        self._append("ledger", {"task": task, "seq": int(datetime.now(UTC).timestamp() * 1_000_000)} | fields, UPDATES)

    def close(self, task: str) -> None:
        self.update(task, state="closed")

    def state(self, task: str, compact: bool = False) -> DataFrame:
        folded = context.ledger(self._read("ledger", UPDATES).where(F.col("task") == task))
        return context.compact_ledger(folded) if compact else folded

    def store_artifact(self, kind: str, content: str) -> str:
        name = f"artifact_{uuid.uuid4().hex[:8]}"
        self._append("artifacts", {"id": name, "kind": kind, "content": content}, ARTIFACTS)
        return name

    def store_artifacts(self, rows: DataFrame) -> None:
        """Append rows (id, kind, content) that aren't stored yet."""
        new = rows.join(self._read("artifacts", ARTIFACTS).select("id"), "id", "left_anti")
        new.select("id", "kind", "content").write.mode("append").parquet(f"{self.folder}/artifacts")

    def store_pack(self, pack: dict) -> str:
        """Keep a context pack; returns its id."""
        self._append("packs", {"id": pack["id"], "task": pack["task"], "content": json.dumps(pack, default=str)}, PACKS)
        return pack["id"]

    def pack(self, name: str) -> dict | None:
        row = self._read("packs", PACKS).where(F.col("id") == name).first()
        return json.loads(row.content) if row else None

    def artifact(self, name: str) -> DataFrame:
        return context.artifacts(self._read("artifacts", ARTIFACTS).where(F.col("id") == name))

    def excerpt(self, name: str, start: int = 1, end: int = 50, max_tokens: int = 1500) -> DataFrame:
        return context.excerpt(self._read("artifacts", ARTIFACTS).where(F.col("id") == name), start, end, max_tokens)


class TaskWorkspace:
    """Copies of the files that a task may change."""

    def __init__(self, repository: str, folder: str, files: list[str]):
        self.repository, self.folder, self.files = Path(repository), Path(folder), files
        for name in files:
            target = self.folder / name
            if not target.resolve().is_relative_to(self.folder.resolve()):
                raise ValueError(f"{name} leaves the workspace")
            target.parent.mkdir(parents=True, exist_ok=True)
            if (self.repository / name).is_file() and not target.exists():
                shutil.copy(self.repository / name, target)

    def patch(self) -> str:
        return workspace.patch(str(self.repository), str(self.folder), self.files)

    def status(self) -> dict:
        added, removed = workspace.patch_lines(self.patch())
        return {"files": len(self.files), "added": added, "removed": removed}

    def apply(self, dry_run: bool = True) -> list[str]:
        """Files that differ; they are copied back unless it is a dry run."""
        read = lambda p: p.read_bytes() if p.is_file() else None
        changed = [n for n in self.files if read(self.folder / n) != read(self.repository / n)]
        if not dry_run:
            for name in changed:
                (self.repository / name).parent.mkdir(parents=True, exist_ok=True)
                shutil.copy(self.folder / name, self.repository / name)
        return changed
