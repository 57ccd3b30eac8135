"""Version-control state as small DataFrames; the commands run on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def git(path: str, *arguments: str, timeout: int = 10) -> str | None:
    try:
        return subprocess.run(["git", "-C", path, *arguments], capture_output=True, text=True, timeout=timeout, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def head(path: str) -> str | None:
    return git(path, "rev-parse", "HEAD")


def commits_between(path: str, old: str, new: str = "HEAD") -> int | None:
    count = git(path, "rev-list", "--count", f"{old}..{new}")
    return int(count) if count and count.isdigit() else None


def change_status(code: Column) -> Column:
    return F.when(code == "A", "added").when(code == "D", "deleted").when(F.startswith(code, F.lit("R")), "renamed").otherwise("modified")


def parse_name_status(lines: DataFrame) -> DataFrame:
    """path and status of ``name-status`` lines (column value); a rename keeps both paths, tab-separated."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.length("value") > 0).select(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("path"), change_status(parts[0]).alias("status"))


def changed_files(spark: SparkSession, path: str, ref: str = "HEAD~1") -> DataFrame:
    text = git(path, "diff", "--name-status", ref) or ""
    return parse_name_status(spark.createDataFrame([(line,) for line in text.splitlines()], "value string"))


def staleness(services: DataFrame, heads: DataFrame) -> DataFrame:
    """Each service's state against its repository's head (service, head, behind)."""
    joined = services.join(heads, "service", "left")
    stale = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("last_commit"))
    behind = F.coalesce(F.concat(F.col("behind").cast("string"), F.lit(" commit(s) behind")), F.lit("never indexed"))
    return joined.select("service", "last_commit", "head", F.when(F.col("head").isNull(), "unknown").when(stale, "stale").otherwise("up_to_date").alias("status"), F.when(stale, behind).alias("message"))
