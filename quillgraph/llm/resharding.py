"""Operator 6, sharding: minimum-cost-flow resharding.

The old shards' sizes and the new shards' capacities make a flow network:
source -> old shard -> new shard -> sink, in which a byte costs 0 if it stays
in the shard of the same number and 1 if it moves.  The cheapest flow that
ships everything is solved on the driver (its nodes are shards, their number
is a parameter) and says how many bytes each old shard keeps and sends where,
which moves the fewest bytes.  Each old shard's rows, largest first, are then
laid end to end; the row whose middle falls into a transfer's interval goes
with it.  As the small rows come last, where the cuts lie, the new shards'
sizes are equal but for less than a few small rows.

Law of the query: ``bytes``.  A row's size is the UTF-8 bytes of its text
(null: none) plus 16.

Running totals are taken in two steps, over groups of (old shard, power of two
of the size, hash), so no task gets a whole shard; a shard has so many hash
parts that each has about ``PART_ROWS`` rows, and only the sums of the groups
are put in order together, shard by shard.

Defined cases: a null doc_id or text is placed like any other; equal rows are
rows of their own and interchangeable; more new shards than rows leave empty
ones; an empty table gives no rows; other columns are ignored by the plan and
carried by ``rewrite``.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.frames import cut, read, size_bytes

OVERHEAD = 16
OLD_SHARDS = 32
NEW_SHARDS = 40
SPLIT = 16
PART_ROWS = 100_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow {(i, j): amount} that ships all supply, capacities permitting.

    Successive shortest paths with potentials, so reduced costs stay
    non-negative and Dijkstra's algorithm finds each path; a path carries as
    much as its narrowest edge.
    """
    import heapq

    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, left, price = [], [], []

    def edge(a: int, b: int, most: int, each: int) -> int:
        for x, y, c, p in ((a, b, most, each), (b, a, 0, -each)):
            head[x].append(len(to))
            to.append(y)
            left.append(c)
            price.append(p)
        return len(to) - 2

    for i, s in enumerate(supply):
        edge(start, i, s, 0)
    middle = {(i, j): edge(i, n + j, s, cost(i, j)) for i, s in enumerate(supply) for j in range(m)}
    for j, c in enumerate(capacity):
        edge(n + j, end, c, 0)
    potential = [0] * (n + m + 2)
    while True:
        far = [math.inf] * (n + m + 2)
        via = [-1] * (n + m + 2)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in head[x]:
                if left[e] > 0 and (nd := d + price[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if far[end] == math.inf:
            return {k: left[e + 1] for k, e in middle.items() if left[e + 1]}
        potential = [p + min(f, far[end]) for p, f in zip(potential, far, strict=True)]
        amount, x = math.inf, end
        while x != start:
            amount = min(amount, left[via[x]])
            x = to[via[x] ^ 1]
        x = end
        while x != start:
            left[via[x]] -= amount
            left[via[x] ^ 1] += amount
            x = to[via[x] ^ 1]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def running(df: DataFrame, shard: str, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of value over the rows before, in the order of (group, order) within each shard, in two steps."""
    keys = [shard, *group]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    base = Window.partitionBy(shard).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(base), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, keys).withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_in", "_base")


def parts(rows: int, part_rows: int) -> int:
    """Hash parts of a shard with so many rows."""
    return max(SPLIT, -(-rows // part_rows))


def plan(rows: DataFrame, new_shards: int = NEW_SHARDS, capacities: list[int] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows (row_key, size, old_shard and any others) with the shard that each goes to.

    The driver gets one sum an old shard.
    """
    sums = rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    totals = {r.old_shard: r["size"] for r in sums}
    split = parts(max((r.n for r in sums), default=0), part_rows)
    n = max(totals, default=-1) + 1
    supply = [totals.get(i, 0) for i in range(n)]
    capacity = equal_capacities(sum(supply), new_shards) if capacities is None else capacities
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold all rows")
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    pieces = []
    for i in range(n):
        at = 0
        for j in sorted((j for (k, j) in flow if k == i), key=lambda j: (j != i, j)):
            pieces.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    spark = rows.sparkSession
    intervals = spark.createDataFrame(pieces or [(-1, 0, 0, -1)], "p_old int, low long, high long, shard int")
    # Sizes descend: the class is the negative power of two.
    classed = rows.withColumn("_class", -F.floor(F.log2(F.col("size"))).cast("int")).withColumn("_part", F.pmod("row_key", F.lit(split)).cast("int"))
    laid = running(classed, "old_shard", ["_class", "_part"], [F.desc("size"), F.col("row_key")], F.col("size"), "_before")
    middle = F.col("_before") + F.floor(F.col("size") / 2)
    # At most one interval for each pair of shards: a table of proven size.
    return laid.join(F.broadcast(intervals), (F.col("old_shard") == F.col("p_old")) & (middle >= F.col("low")) & (middle < F.col("high"))).drop("p_old", "low", "high", "_before", "_class", "_part")


def slots(placed: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds slot, without gaps from 0 in each shard, in a hashed order."""
    largest = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parted = placed.withColumn("_part", F.pmod(F.shiftright("row_key", 8), F.lit(parts(largest, part_rows) * 4)).cast("int"))
    return running(parted, "shard", ["_part"], [F.col("row_key"), F.col("size")], F.lit(1), "slot").drop("_part")


def keyed(documents: DataFrame) -> DataFrame:
    """Size, checksum and a hash of each row; the old shard is that of the layout by doc_id."""
    text = F.coalesce("text", F.lit(""))
    sized = documents.select("doc_id", (size_bytes(F.col("text")) + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("row_key"))
    return sized.withColumn("old_shard", F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)).cast("int"))


def reshard(documents: DataFrame, new_shards: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot of each document."""
    return slots(cut(plan(cut(keyed(documents)), new_shards)))


def moved_bytes(placed: DataFrame) -> DataFrame:
    """Bytes in all, and bytes that change their shard."""
    return placed.agg(F.sum("size").alias("bytes"), F.sum(F.when(F.col("old_shard") != F.col("shard"), F.col("size")).otherwise(0)).alias("moved"))


def rewrite(stored: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write anew, under ``path/shard=N``, the shards whose rows change; returns their numbers.

    ``stored`` has the columns of documents and ``old_shard``.  A shard into
    or out of which nothing moves keeps its files.
    """
    changed = placed.where("old_shard <> shard")
    numbers = sorted(r.n for r in changed.select(F.explode(F.array("old_shard", "shard")).alias("n")).distinct().collect())
    key = F.xxhash64("doc_id", "text").alias("row_key")
    target = placed.where(F.col("shard").isin(numbers)).select("row_key", "shard", "old_shard").groupBy("row_key", "old_shard").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    number = F.row_number().over(Window.partitionBy("row_key", "old_shard").orderBy("doc_id"))
    rows = stored.select("*", key).withColumn("_k", number).join(target, ["row_key", "old_shard"]).withColumn("shard", F.try_element_at("shards", F.col("_k")))
    rows.where(F.col("shard").isNotNull()).drop("_k", "shards", "row_key", "old_shard").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("shard").parquet(path)
    filled = {r.shard for r in placed.where(F.col("shard").isin(numbers)).select("shard").distinct().collect()}
    spark = stored.sparkSession
    for n in sorted(set(numbers) - filled):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={n}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return numbers


def imbalance(sizes: list[int]) -> Fraction:
    return Fraction(max(sizes) * len(sizes), max(1, sum(sizes)))


def op6_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")
