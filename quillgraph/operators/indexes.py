"""Indexes that are kept beside chunks and nodes: vectors by nearest centroid, texts by trigram.

Both only choose what is read; what is read is compared in full, so results
are those of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillgraph.operators.lineage import cut
from quillgraph.workers import small_batches, workers_import

#: Lists of a vector index and vectors that its centroids are fitted on (those of least hash).
LISTS, SAMPLE = 64, 4096
#: Rows of a list, and queries that ask it, that meet in one cell; queries and pairs that are compared at once there.
PART_ROWS, QUERY_ROWS, QUERY_STEP, PAIRS = 1 << 14, 1 << 14, 256, 1 << 16
#: Distances are compared as ``search.vector`` gives them, in six decimals.
DIGITS = 6


def _centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Farthest-first starts, then means of what is nearest."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(lists, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(1)
        for k in np.unique(near):
            centres[k] = sample[near == k].mean(0)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors, none of them null, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def _unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


@dataclass
class VectorIndex:
    """Vectors in lists by nearest centroid; ``metric`` is l2 (squared) or cosine (of vectors brought to length 1)."""

    entries: DataFrame  # list, part, id, embedding
    centroids: np.ndarray
    lists: DataFrame  # list, rows, parts, low, high: distances from the centroid; one row a list
    metric: str

    def write(self, path: str) -> None:
        """Keep the index in a folder, its entries by list."""
        spark = self.entries.sparkSession
        self.entries.write.mode("overwrite").partitionBy("list").parquet(f"{path}/entries")
        centroids = spark.createDataFrame([(k, [float(x) for x in c], self.metric) for k, c in enumerate(self.centroids)], "list int, centroid array<double>, metric string")
        centroids.join(self.lists, "list", "left").write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list")
        kept = rows.select("list", "centroid", "metric").collect()
        lists = rows.where(F.col("rows").isNotNull()).select("list", "rows", "parts", "low", "high")
        return cls(spark.read.parquet(f"{path}/entries"), np.array([r.centroid for r in kept]), lists, kept[0].metric)


def index_vectors(chunks: DataFrame, lists: int = LISTS, metric: str = "l2") -> VectorIndex | None:
    """Index of chunks (id, embedding of one length); None if there are none.

    Null vectors, and for the cosine those of length 0, are near to nothing and
    left out, as are such queries.  Centroids are fitted on a bounded sample;
    all other chunks are in the index.
    """
    workers_import(chunks.sparkSession)
    rows = chunks.select("id", (F.col("embedding") if metric == "l2" else _unit(F.col("embedding"))).alias("embedding")).where(F.col("embedding").isNotNull())
    sample = [r.embedding for r in rows.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()]
    if not sample:
        return None
    dims = len(sample[0])
    centres = _centroids(np.array(sample, float), lists)

    @F.arrow_udf("list int, away double")
    def nearest(vectors: pa.Array) -> pa.Array:
        away = _distances(_matrix(vectors, dims), centres)
        near = away.argmin(1)
        return pa.StructArray.from_arrays([pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], ["list", "away"])

    placed = cut(rows.withColumn("_at", nearest("embedding")).select("_at.list", "_at.away", "id", "embedding"))
    table = cut(placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.min("away").alias("low"), F.max("away").alias("high")).withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int")))
    # A list of more than PART_ROWS rows is dealt to several keys; parts are told by the chunk's id.
    entries = placed.join(F.broadcast(table.select("list", "parts")), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "embedding")
    return VectorIndex(entries, centres, table.select("list", "rows", "parts", "low", "high"), metric)


def _near_in_cell(top: int, dims: int, slack: float):
    """Vectors of a cell and the queries that ask it: a superset of each query's nearest ``top`` not beyond its bound, with squared distances.

    A matrix product only chooses; distances are computed from the differences.
    Of vectors equally far from a query those with the least ids suffice.
    """

    def near(entries: pa.Table, asked: pa.Table) -> pa.Table:
        kept: list[tuple] = []
        entries, asked = entries.combine_chunks(), asked.combine_chunks()
        if entries.num_rows and asked.num_rows:
            entries = entries.take(pc.sort_indices(entries.column("id"))).combine_chunks()
            have, ask = (_matrix(t.column(c).combine_chunks(), dims) for t, c in ((entries, "embedding"), (asked, "point")))
            most = asked.column("most").to_numpy()
            own = (have * have).sum(1)
            for low in range(0, len(ask), QUERY_STEP):
                part = ask[low : low + QUERY_STEP]
                away = (part * part).sum(1)[:, None] + own - 2 * part @ have.T
                limit = most[low : low + QUERY_STEP]
                if not np.isfinite(limit).all() and len(have) > top:
                    limit = np.minimum(limit, np.partition(away, top - 1, axis=1)[:, top - 1])
                q, e = np.nonzero(away <= (limit + slack * (1 + own.max() + (part * part).sum(1)))[:, None])
                exact = np.concatenate([np.zeros(0), *(((have[e[k : k + PAIRS]] - part[q[k : k + PAIRS]]) ** 2).sum(1) for k in range(0, len(q), PAIRS))])
                order = np.lexsort((e, exact, q))
                q, e, exact = q[order], e[order], exact[order]
                begins = np.r_[True, (q[1:] != q[:-1]) | (exact[1:] != exact[:-1])][: len(q)]
                place = np.arange(len(q)) - np.maximum.accumulate(np.where(begins, np.arange(len(q)), 0))
                few = place < top
                kept.append((q[few] + low, e[few], exact[few]))
        q, e, exact = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query": asked.column("query").take(pa.array(q)), "id": entries.column("id").take(pa.array(e)), "squared": pa.array(exact, pa.float64())})

    return near


def search_vectors(index: VectorIndex, queries: DataFrame, top: int) -> DataFrame:
    """(query, id, distance, rank): the nearest ``top`` of each query (query, point) by distance and id, all queries in one plan.

    A list lies between its least and greatest distance from its centroid, so by
    the triangle inequality none of its vectors is nearer to a query than the
    query's own distance from the centroid is to that range.  The lists that are
    nearest by this bound, enough to hold ``top`` vectors, are read first; then
    those whose bound doesn't exceed the distance of the last one found.  A part
    of a list and a block of the queries that ask it meet in a task (a cell), as
    two matrices; rows are made only for vectors that can be among the nearest.
    """
    workers_import(queries.sparkSession)
    centres, cosine = index.centroids, index.metric == "cosine"
    dims, scale = centres.shape[1], 2 if cosine else 1
    points = queries.select("query", (_unit(F.col("point")) if cosine else F.col("point")).alias("point")).where(F.col("point").isNotNull())
    # One row a list, at most LISTS.
    known = sorted(index.lists.select("list", "rows", "low", "high").collect())
    place, rows, least, greatest = (np.array(x) for x in zip(*known, strict=True))

    @F.arrow_udf("array<struct<list: int, bound: double, before: long>>")
    def bounds(vectors: pa.Array) -> pa.Array:
        away = _distances(_matrix(vectors, dims), centres)[:, place]
        bound = np.maximum(np.maximum(away - greatest, least - away), 0)
        order = np.argsort(bound, axis=1, kind="stable")
        held = rows[order]
        columns = [pa.array(place[order].ravel().astype(np.int32)), pa.array(np.take_along_axis(bound, order, 1).ravel()), pa.array((np.cumsum(held, axis=1) - held).ravel())]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1, dtype=np.int32) * len(place)), pa.StructArray.from_arrays(columns, ["list", "bound", "before"]))

    told = cut(points.withColumn("told", bounds("point")))
    sizes = index.lists.select("list", "parts")
    kinds = {**dict(index.entries.dtypes), **dict(points.dtypes)}
    cell = ["list", "part", "block"]

    def nearest(asked: DataFrame) -> DataFrame:
        """asked: query, point, list, most (greatest squared distance of use)."""
        blocks = cut(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks")).join(F.broadcast(sizes), "list"))
        keyed = asked.join(F.broadcast(blocks), "list").select("query", "point", "most", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"))
        held = index.entries.join(F.broadcast(blocks.select("list", "blocks")), "list").select("id", "embedding", "list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        met = held.groupBy(*cell).cogroup(keyed.groupBy(*cell)).applyInArrow(_near_in_cell(top, dims, 8 * scale * 10.0**-DIGITS), f"query {kinds['query']}, id {kinds['id']}, squared double")
        return met.select("query", "id", F.round(F.col("squared") / scale, DIGITS).alias("distance"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= top)

    first = told.select("query", "point", F.explode(F.filter("told", lambda t: t["before"] < top)).alias("t"))
    near = cut(ranked(nearest(first.select("query", "point", "t.list", F.lit(float("inf")).alias("most")))))
    last = near.groupBy("query").agg(F.max("distance").alias("last"))
    most = (F.col("last") + 2 * 10.0**-DIGITS) * scale
    rest = told.join(last, "query").withColumn("most", most).withColumn("reach", F.sqrt("most") + 1e-9)
    rest = rest.select("query", "point", "most", F.explode(F.filter("told", lambda t: (t["before"] >= top) & (t["bound"] <= F.col("reach")))).alias("t"))
    return ranked(nearest(rest.select("query", "point", "t.list", "most")).unionByName(near.drop("rank"))).select("query", "id", "distance", "rank")


# ---- texts by trigram


GRAM, TEXTS_EACH = 3, 64


@F.arrow_udf(ArrayType(StringType()))
def grams(texts: pa.Array) -> pa.Array:
    """Distinct runs of three characters of each text (null: none); Python objects are held for a few texts at a time."""
    kind = pa.list_(pa.string())
    parts = [pa.array([sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) if t else [] for t in texts.slice(low, TEXTS_EACH).to_pylist()], kind) for low in range(0, len(texts), TEXTS_EACH)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def postings(nodes: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(gram, *key) for each trigram of any of the fields; sorted by gram, so a pattern reads the few row groups of its grams."""
    workers_import(nodes.sparkSession)
    small_batches(nodes.sparkSession)
    found = F.flatten(F.array(*(grams(F.lower(F.col(f))) for f in fields)))
    return nodes.select(F.explode(found).alias("gram"), *key).distinct()


def write_postings(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def containing(nodes: DataFrame, index: DataFrame, pattern: str, key: list[str], fields: list[str]) -> DataFrame:
    """Nodes of which a field contains the pattern, in whatever case.

    Candidates have all of the pattern's trigrams; each is checked.  A pattern of
    fewer characters has none and all nodes are looked at.
    """
    spark = nodes.sparkSession
    workers_import(spark)
    needle = F.lower(F.lit(pattern))
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), needle) for f in fields))
    wanted, size = spark.range(1).select(grams(needle), F.char_length(needle)).first()
    if size < GRAM:
        return nodes.where(hit)
    have = index.where(F.col("gram").isin(wanted)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(*key)
    return nodes.join(have, key, "left_semi").where(hit).select(*nodes.columns)
