"""Parsing of source files: one record a file, on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.parse.braces import DECLARATIONS, parse_braces
from quillgraph.parse.documents import is_compose, is_openapi, parse_compose, parse_openapi, parse_workflow, record
from quillgraph.parse.python_source import parse_python
from quillgraph.schemas import LANGUAGES, PARSED
from quillgraph.workers import workers_import


def parse_source(path: str, source: str | None) -> dict:
    """Route a file by its name: API description, compose file, workflow, or a language's parser."""
    source = source or ""
    language = LANGUAGES.get(os.path.splitext(path.lower())[1])
    if is_openapi(path):
        return parse_openapi(path, source)
    if is_compose(path):
        return parse_compose(path, source)
    if language == "yaml":
        return parse_workflow(path, source)
    if language == "python":
        return parse_python(path, source)
    if language in DECLARATIONS:
        return parse_braces(path, source, language)
    return record(path, "typescript", errors=[f"Unsupported file extension: {os.path.splitext(path)[1]}"])


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        records = [parse_source(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield pd.DataFrame({"service": batch["service"].to_list()} | {k: [r[k] for r in records] for k in ("file", "language", "symbols", "classes", "infra", "dags", "errors")}, dtype=object)


def parse_files(files: DataFrame) -> DataFrame:
    """service and the parsed record of each of (service, path, content).

    The only stage in Python; it is narrow, so a file is read and parsed in
    one task, and only the record goes on.
    """
    workers_import(files.sparkSession)
    return files.select("service", "path", "content").mapInPandas(_parse_batches, f"service string, {PARSED}")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """One row a function: service, file, language, position in the file and the symbol's fields."""
    return parsed.select("service", "file", "language", F.posexplode("symbols").alias("ordinal", "s")).select("service", "file", "language", "ordinal", "s.*")


def classes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("service", "file", "language", F.posexplode("classes").alias("ordinal", "c")).select("service", "file", "language", "ordinal", "c.*")


def infra_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("service", "file", F.posexplode("infra").alias("ordinal", "i")).select("service", "file", "ordinal", "i.*")


def tasks_of(parsed: DataFrame) -> DataFrame:
    dags = parsed.select("service", "file", F.explode("dags").alias("d"))
    return dags.select("service", "file", F.col("d.name").alias("dag"), F.explode("d.tasks").alias("t")).select("service", "file", "dag", "t.*")


def dags_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("service", "file", F.explode("dags").alias("d")).select("service", "file", "d.*")
