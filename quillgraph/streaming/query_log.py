"""The query log as a stream: windowed reports and hit counts. An extension beyond the batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, query string, top_id string, top_score double"


def read_events(spark: SparkSession, path: str, files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).parquet(path)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Frequency and mean score of each query in tumbling windows; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "query").agg(F.count(F.lit(1)).alias("frequency"), F.avg("top_score").alias("avg_score"), F.count_if(F.col("top_score") < 0.4).alias("gaps")).select("w.start", "w.end", "query", "frequency", "avg_score", "gaps")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write_windows(events: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append closed windows; a file source and sink with a checkpoint give each event's effect once."""
    return windowed(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def maintain_hits(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Hit counts of each chunk by micro-batch: a batch replaces its own folder, so a retried one counts once."""

    def store(batch: DataFrame, number: int) -> None:
        batch.where(F.col("top_id").isNotNull()).groupBy(F.col("top_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_queried")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("id").agg(F.sum("hits").alias("hit_count"), F.max("last_queried").alias("last_queried"))
