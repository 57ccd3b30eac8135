"""Pipeline over documents: quality rules, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of documents.

Defined cases, in every stage: a null text counts as an empty one, which the
first stage rejects as too short; a null source is a source of its own; a null
doc_id is last in order; rows that repeat each other are documents of their
own until near-dedup keeps one of them; further columns are dropped; empty
documents give an empty result.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import line_rules, mixing, near_copies, packing, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are frequent on their host."""
    return line_rules.clean(docs, keep_first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: operator 7's SimHash links, checked, then those of least hashes (five-word shingles, similarity 0.8 or more)."""
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as far, as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence of each piece of each document."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mix), ("packing", pack)]
#: SQL can express neither least-hash signatures nor the token-efficiency test; tests hold the stages against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them lies in the cluster's checkpoint folder until the next stage is written."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pipeline-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run_id = uuid.uuid4().hex
    paths = [os.path.join(folder, f"pipeline-{run_id}", str(k)) for k in range(len(STAGES))]
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            remove(spark, paths[k - 1])
    return docs
