"""Chunks, hits and promoted patterns: appends, upserts and deletes by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalar import slug


def append_events(events: DataFrame, path: str) -> None:
    """Append query events, by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def delete_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids, "id", "left_anti")


def upsert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks with those of ``new`` in place of equal ids; of equal new ids that with the greatest document.

    Hits are kept apart (``with_hits``), so replacing a chunk doesn't reset them.
    """
    others = [c for c in new.columns if c != "id"]
    once = new.groupBy("id").agg(F.max_by(F.struct(*others), "document").alias("r")).select("id", "r.*")
    return chunks.join(once.select("id"), "id", "left_anti").unionByName(once, allowMissingColumns=True)


def get_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids, "id", "left_semi")


def hit_counts(events: DataFrame) -> DataFrame:
    """Hits and last query time of each chunk, from the event log."""
    return events.where(F.col("top_id").isNotNull()).groupBy(F.col("top_id").alias("id")).agg(F.count(F.lit(1)).alias("hit_count"), F.max("ts").alias("last_queried"))


def with_hits(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Chunks with their hits; re-indexing a chunk never resets them, as they are kept apart."""
    return chunks.join(hits, "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))


def promoted(hot: DataFrame, existing: DataFrame) -> DataFrame:
    """Hot queries whose slug isn't there yet."""
    return hot.join(existing, "slug", "left_anti")


def pattern_files(hot: DataFrame) -> DataFrame:
    """slug, query and Markdown body of hot queries (query, frequency)."""
    body = F.concat_ws("\n", F.concat(F.lit("# "), "query"), F.lit(""), F.concat(F.lit("Asked "), F.col("frequency").cast("string"), F.lit(" times.")))
    return hot.select(slug(F.col("query")).alias("slug"), "query", body.alias("body"))
