"""Spark helpers shared by the operators: Arrow maps, components, sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.lineage import cut
from quillgraph.workers import small_batches, workers_import

__all__ = ["arrow_map", "bitmap", "components", "cut", "marked", "partitions_for", "read", "roots", "size_bytes", "whole_partition", "workers_import"]

#: Bits of a bitmap of keys (2 MB), whatever their number: more keys let more other rows through, and none is lost.
BITS = 1 << 24
_PAGE_BITS = 15


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    workers_import(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def whole_partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a partition; None if there are no rows."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each has about ``rows_each`` rows, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def _page_and_bit(*keys: str) -> tuple[Column, Column]:
    number = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    return F.shiftright(number, _PAGE_BITS).alias("page"), number.bitwiseAND(F.lit((1 << _PAGE_BITS) - 1)).alias("bit")


def bitmap(keys: DataFrame) -> DataFrame:
    """(page, bits) with the bit of each of the distinct keys' hashes set: at most BITS of them, to be broadcast."""
    return keys.select(*_page_and_bit(*keys.columns)).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(df: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """The rows, nothing shuffled, with ``marked``: true for every row whose key is in the bitmap and for few others."""
    page, bit = _page_and_bit(*keys)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # The byte moved left by 7 less the bit's place has that bit at place 7.
    found = F.coalesce(F.expr("shiftleft(byte, 7 - cast(bit & 7 as int)) & 128"), F.lit(0)) > 0
    paged = df.select("*", page, bit).join(F.broadcast(bits), "page", "left").withColumn("byte", byte)
    return paged.withColumn("marked", found).select(*df.columns, "marked")


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for links a-b between nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = whole_partition(batches)
    if table is None:
        return
    nodes, index = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    label = roots(index[: table.num_rows], index[table.num_rows :], len(nodes))
    other = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a long, b long), for nodes that have a link.

    Each partition first contracts its links to a forest, so at most one link
    a node and partition is left.  Then rounds of minimum labels over the links
    with pointer jumping, until nothing changes; every round is cut to the
    checkpoint folder.  A node with very many links is only ever joined and
    summed (partial minimum), never gathered.
    """
    forest = cut(arrow_map(links.where("a <> b").select("a", "b"), _forest, "a long, b long").distinct())
    both = forest.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(forest.select(F.col("b").alias("node"), F.col("a").alias("near")))
    labels = cut(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        lowest = both.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("low"))
        hooked = labels.join(lowest, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut(hooked.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return labels


def size_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
