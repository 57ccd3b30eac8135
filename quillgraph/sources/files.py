"""Source trees as DataFrames: scan, hashes, incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.scalar import content_hash, language_of
from quillgraph.schemas import LANGUAGES, SKIPPED_DIRECTORIES

INDEX_SCHEMA = "path string, content_hash string, last_commit string, indexed_at timestamp"
SERVICE_INDEX_SCHEMA = f"service string, {INDEX_SCHEMA}"
SOURCE_SCHEMA = "service string, path string, content string, language string, content_hash string"


def wanted(path: str = "path") -> F.Column:
    """Files of a known language outside the skipped directories."""
    inside = F.split(F.col(path), "/")
    return ~F.arrays_overlap(inside, F.array(*map(F.lit, SKIPPED_DIRECTORIES))) & language_of(F.col(path)).isNotNull()


def select_files(files: DataFrame) -> DataFrame:
    """The rows of (service, path, content) that a scan keeps, with language and hash."""
    return files.where(wanted()).withColumn("language", language_of(F.col("path"))).withColumn("content_hash", content_hash(F.col("content")))


def scan(spark: SparkSession, root: str, service: str) -> DataFrame:
    """service, path (below the root), content, language and content_hash of a tree's source files.

    Names are filtered by Spark's reader, so files of other kinds aren't opened.
    """
    extensions = ",".join(x[1:] for x in LANGUAGES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{extensions}}}").load(root)
    base = F.regexp_replace(F.col("path"), "^[a-z]+:(?://)?(?=/)", "")
    below = F.expr("substring(p, length(root) + 2)")
    named = raw.select(base.alias("p"), F.lit(root.rstrip("/")).alias("root"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return select_files(named.select(F.lit(service).alias("service"), below.alias("path"), "content"))


def mark_changed(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Adds changed: new, or with another hash than the index has."""
    old = index.select(F.col("path").alias("_path"), F.col("content_hash").alias("_old"))
    joined = files.join(old, files.path == old._path, "left")
    return joined.withColumn("changed", F.lit(force) | ~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_path", "_old")


def deleted(files: DataFrame, index: DataFrame) -> DataFrame:
    """Indexed paths that are no longer there."""
    return index.join(files, "path", "left_anti").select("path")


def upsert(existing: DataFrame, new: DataFrame, key: list[str], sequence: str, first_seen: str | None = None) -> DataFrame:
    """Rows of both; of equal keys that with the highest sequence, and the earliest first_seen.

    One aggregation: the newest row by ``max_by`` of the whole row, so a key
    with many versions is summed before it is shuffled.
    """
    rows = existing.unionByName(new, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*others), F.col(sequence)).alias("_row")
    kept = rows.groupBy(*key).agg(newest, *([F.min(first_seen).alias("_first")] if first_seen else []))
    return kept.select(*key, *(F.col("_first").alias(c) if c == first_seen else F.col(f"_row.{c}").alias(c) for c in others))


def insert_absent(existing: DataFrame, new: DataFrame, key: str, seen: str) -> DataFrame:
    """Existing rows with a refreshed ``seen``, and new rows with keys that weren't there."""
    latest = new.groupBy(key).agg(F.max(seen).alias("_seen"))
    refreshed = existing.join(latest, key, "left").withColumn(seen, F.greatest(F.col(seen), F.col("_seen"))).drop("_seen")
    return refreshed.unionByName(new.join(existing, key, "left_anti").dropDuplicates([key]))


def sync_metadata(services: DataFrame, runs: DataFrame) -> DataFrame:
    """Services with the commit, time and file count of their newest run; a run without a commit keeps the old one."""
    joined = services.join(runs, "service", "left")
    ran = F.col("files").isNotNull()
    return joined.select("service", F.coalesce("commit", "last_commit").alias("last_commit"), F.when(ran, F.current_timestamp()).alias("last_sync"), F.coalesce("files", "file_count").alias("file_count"))
