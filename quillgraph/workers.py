"""Python workers that can import this package and are given small batches."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's path names it."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, environment.get("PYTHONPATH", "")) if x)


#: Rows of an Arrow batch: Spark's 10 000 are 40 MB of common texts in each of a worker's and the JVM's buffers, and any amount of long ones.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ``BATCH_ROWS``, if they are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
