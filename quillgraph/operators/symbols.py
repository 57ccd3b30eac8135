"""What surrounds a symbol: callers, callees, community, processes, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(functions: DataFrame, name: str, service: str | None = None, limit: int = 5) -> DataFrame:
    """Symbols of a name with an ambiguity flag, in a total order."""
    rows = functions.where(F.col("name") == name)
    rows = rows if service is None else rows.where(F.col("service") == service)
    place = F.row_number().over(Window.partitionBy("name").orderBy("service", "file", "id"))
    counted = rows.withColumn("place", place).withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)
    return counted.where(F.col("place") <= limit)


def neighbours(edges: DataFrame, functions: DataFrame, starts: DataFrame, side: str, limit: int = 15) -> DataFrame:
    """Callers (side in) or callees (side out) of the start nodes, most confident first."""
    near, far = ("dst", "src") if side == "in" else ("src", "dst")
    hits = edges.join(starts.select(F.col("id").alias(near)), near, "left_semi").groupBy(F.col(far).alias("id")).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    return hits.join(functions, "id").orderBy(F.desc("confidence"), "id").limit(limit)


def grouped_neighbours(edges: DataFrame, names: DataFrame, functions: DataFrame, side: str, most: int = 3) -> DataFrame:
    """For each name its first distinct caller or callee names."""
    near, far = ("dst", "src") if side == "in" else ("src", "dst")
    own = functions.select(F.col("id").alias(near), F.col("name").alias("target")).join(names, "target", "left_semi")
    other = functions.select(F.col("id").alias(far), F.col("name").alias("other"))
    return edges.join(own, near).join(other, far).groupBy("target").agg(F.slice(F.array_sort(F.collect_set("other")), 1, most).alias("names"))


def augment(matched: DataFrame, facets: dict[str, DataFrame]) -> DataFrame:
    """Matched symbols with each facet (target, names), by name; empty where there is none."""
    out = matched
    for column, facet in facets.items():
        out = out.join(facet.select(F.col("target").alias("name"), F.col("names").alias(column)), "name", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def one_hop(edges: DataFrame, kind: str, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """Targets of one edge type from the starts."""
    rows = edges.where(F.col("type") == kind).join(starts.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().orderBy("id")
    return rows if limit is None else rows.limit(limit)


def memberships(steps: DataFrame, starts: DataFrame, limit: int = 5) -> DataFrame:
    """Processes that the starts (id) are steps of, longest first: process, step_count and the position."""
    own = steps.join(starts.select(F.col("id").alias("node")), "node", "left_semi").select("process", "step", "node")
    size = steps.groupBy("process").agg(F.count(F.lit(1)).alias("step_count"))
    return own.join(size, "process").orderBy(F.desc("step_count"), "process", "step").limit(limit)


def process_members(steps: DataFrame) -> DataFrame:
    """Functions of each process in the order of their step."""
    return steps.groupBy("process").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]).alias("steps"))


def service_counts(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Files and functions of each service; each side is counted before they are joined."""
    f = files.groupBy("service").agg(F.count_distinct("file").alias("files"))
    n = functions.groupBy("service").agg(F.count(F.lit(1)).alias("functions"))
    return f.join(n, "service", "full_outer").select("service", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("functions", F.lit(0)).alias("functions"))


def overview(functions: DataFrame, edges: DataFrame, service: str) -> DataFrame:
    """One row of counts for a service, also where it has no functions."""
    own = functions.where(F.col("service") == service)
    n = own.agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("file").alias("files"))
    calls = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count(F.lit(1)).alias("calls"))
    return n.join(calls, F.lit(True)).select(F.lit(service).alias("service"), "functions", "files", "calls")


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("service", "language").agg(F.count(F.lit(1)).alias("n"))
