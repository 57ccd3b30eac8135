"""Operator 11, hard-negative mining by one-dimensional distance keys.

Vectors get one more component, ``sqrt(M - |x|^2)`` with ``M`` the largest
squared length, so that a larger inner product with an anchor is a smaller
distance from it.  Each vector belongs to its nearest pivot and its key is the
distance to that pivot.  The index holds the vectors sorted by (pivot, key) in
tiles, runs of neighbouring keys of about ``TILE_ROWS`` rows.  By the triangle
inequality a tile can't hold a vector nearer to an anchor than the anchor's
pivot distance is from the tile's key interval.  A search scans the tiles within
a reach, grows the reach, and ends for an anchor once what it has found, or the
far end of its score band, proves that no tile beyond the reach can matter.  So
results are exact; pivots and keys only decide how much is read.

The positives are searched first, among vectors of the anchor's label; each
positive's score then bounds a band ``4/5 s .. s`` in which the negatives, of
other labels, are searched: an annulus around the anchor.

Rows of equal label and vector are one entry of the index with their first
``TAKEN + 1`` ids, of which at most so many can be in any result; anchors of
equal label and vector are one search.  So copies in any number cost no more
than one.  Tiles are split where many vectors have one key, and searches that
share a tile are dealt in slices.

Pivots are fitted on at most ``SAMPLE`` entries (those of least hash) on the
driver; every entry is indexed.  The driver also sees one count for each
(pivot, key cell), at most ``PIVOTS * CELLS``.

Defined cases: a row with a null vec_id, label or vector, or a null or
non-finite component, takes no part; vectors of different lengths are filled up
with zeros; repeated rows are rows of their own (an anchor's copy can be its
positive, and a repeated anchor gives its rows again); equal scores go by
smaller vec_id; positives of negative score have no band and so no row; an
anchor without positives or negatives has no row; an empty table gives no
rows.  Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.frames import arrow_map, cut, read

#: Positives of an anchor, and negatives of a positive.
TAKEN = 5
ANCHOR_EVERY = 100
PIVOTS, CELLS, SAMPLE = 32, 256, 4096
#: Entries of a tile: at least so many (where a pivot has them), growing with the table up to ``WIDEST_TILE``.
TILE_ROWS, WIDEST_TILE, TILES = 1024, 1 << 17, 1 << 16
#: Share of the entries that the first reach covers, and its growth.
FIRST, GROWTH = 1 / 16, 8
#: Searches that scan one copy of a tile.
SLICE = 1 << 17
#: Scores that a task holds at a time.
SCORES = 1 << 22


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths, which the first byte names."""
    most = int(np.abs(values).max()) if len(values) else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """One row of whole numbers (as int64) for each packed vector."""
    raw = column.to_pylist()
    out = np.zeros((len(raw), dims), np.int64)
    if raw and len({(x[0], len(x)) for x in raw}) == 1:
        width = raw[0][0]
        values = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, 1:].copy().view(f"<i{width}")
        out[:, : values.shape[1]] = values
    else:
        for k, x in enumerate(raw):
            values = np.frombuffer(x, f"<i{x[0]}", offset=1)
            out[k, : len(values)] = values
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(v, np.int64) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([packed(v) for v in vectors], pa.binary()), pa.array([int(v @ v) for v in vectors], pa.int64()), pa.array([len(v) for v in vectors], pa.int32())],
            ["vec_id", "label", "vector", "norm", "dims"],
        )


def prepare(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, label, whole-number vector (packed), squared length and number of components."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(usable)
    label = F.col("label").cast("long")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("vector"))
    return arrow_map(rows, _pack, "vec_id long, label long, vector binary, norm long, dims int")


@dataclass
class Index:
    """What every task knows: pivots, the cells' tiles and the tiles' key intervals; ``entries`` are the vectors by tile."""

    entries: DataFrame
    pivots: np.ndarray
    most: int
    dims: int
    tile_of: np.ndarray
    pieces: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    @property
    def slack(self) -> float:
        """More than the rounding of a distance."""
        return 1e-6 * (1 + self.most**0.5)


def fitted(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Pivots: farthest-first starts, then means of what is nearest."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = sample[near == k].mean(0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def augmented(vectors: np.ndarray, most: int) -> np.ndarray:
    values = vectors.astype(np.float64)
    return np.c_[values, np.sqrt(np.maximum(most - (values * values).sum(1), 0))]


def build(rows: DataFrame, pivots: int = PIVOTS, cells: int = CELLS, tile_rows: int = TILE_ROWS) -> Index | None:
    """Index of the distinct (label, vector) entries, each with its first ids; None without rows."""
    place = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= TAKEN + 1)
    entries = cut(first.groupBy("label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("norm").alias("norm"), F.first("dims").alias("dims")))
    total, most, dims = entries.agg(F.count(F.lit(1)), F.max("norm"), F.max("dims")).first()
    if not total:
        return None
    sample = entries.select("vector", "label").orderBy(F.xxhash64("vector"), "vector", "label").limit(SAMPLE).toArrow()
    centres = fitted(augmented(unpacked(sample["vector"].combine_chunks(), dims), most), pivots)
    width = 2 * (most**0.5 + 1) / cells

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = distances(augmented(unpacked(batch.column("vector"), dims), most), centres)
                near = away.argmin(1)
                key = away[np.arange(len(near)), near]
                cell = near * cells + np.minimum((key / width).astype(np.int64), cells - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(key)], [*batch.schema.names, "cell", "key"])

    keyed = cut(arrow_map(entries.select("label", "vector", "ids"), assign, "label long, vector binary, ids array<long>, cell int, key double"))
    cell, count, low, high = (np.array(x) for x in zip(*keyed.groupBy("cell").agg(F.count(F.lit(1)), F.min("key"), F.max("key")).orderBy("cell").collect(), strict=True))
    size = min(max(tile_rows, total // TILES), WIDEST_TILE)
    tile_of, pieces = np.zeros(len(centres) * cells, np.int32), np.ones(len(centres) * cells, np.int32)
    tiles: list[list] = []  # pivot, lowest key, highest key, rows
    for c, n, a, b in zip(cell.tolist(), count.tolist(), low.tolist(), high.tolist(), strict=True):
        parts = -(-n // (2 * size))
        if parts == 1 and tiles and tiles[-1][0] == c // cells and tiles[-1][3] < size:
            tiles[-1][2] = b
            tiles[-1][3] += n
            tile_of[c] = len(tiles) - 1
        else:
            tile_of[c], pieces[c] = len(tiles), parts
            tiles += [[c // cells, a, b, n // parts + 1] for _ in range(parts)]
    pivot, low, high, held = (np.array(x) for x in zip(*tiles, strict=True))

    def place_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, part = (batch.column(c).to_numpy() for c in ("cell", "part"))
            tile = tile_of[cell] + part % pieces[cell]
            yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), *(batch.column(c) for c in ("key", "label", "vector", "ids"))], ["tile", "key", "label", "vector", "ids"])

    part = F.pmod(F.xxhash64("label", "vector"), F.lit(1 << 20)).cast("int").alias("part")
    tiled = arrow_map(keyed.select("cell", "key", "label", "vector", "ids", part), place_in, "tile int, key double, label long, vector binary, ids array<long>")
    stored = cut(tiled.repartition("tile").sortWithinPartitions("tile", "key"))
    return Index(stored, centres, most, dims, tile_of, pieces, pivot, low, high, held)


def _bounds(index: Index, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that each search (row) can have from a vector of each tile."""
    away = distances(np.c_[vectors.astype(np.float64), np.zeros(len(vectors))], index.pivots)[:, index.pivot]
    return np.maximum(0, np.maximum(away - index.high, index.low - away)) - index.slack, away + index.high + index.slack


def _extend(share: float, **held):
    """Each open search's new reach: as far as it needs, but not beyond ``share`` of the entries."""
    index = Index(None, **held)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            least, _ = _bounds(index, unpacked(batch.column("vector"), index.dims))
            order = np.argsort(least, axis=1, kind="stable")
            covered = np.cumsum(index.rows[order], axis=1)
            at = np.minimum((covered < share * index.rows.sum()).sum(1), len(index.rows) - 1)
            reach = least[np.arange(len(at)), order[np.arange(len(at)), at]] if share < 1 else np.full(len(at), np.inf)
            reach = np.minimum(reach, batch.column("needed").to_numpy())
            names = [n for n in batch.schema.names if n != "needed"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.maximum(reach, batch.column("reach").to_numpy()))], [*names, "next"])

    return extend


def _spread(slices: int, **held):
    """A row for each tile that a search's grown reach adds."""
    index = Index(None, **held)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unpacked(batch.column("vector"), index.dims)
            least, greatest = _bounds(index, vectors)
            done, now = (batch.column(c).to_numpy()[:, None] for c in ("reach", "next"))
            best = np.array([max(h) for h in batch.column("highs").to_pylist()], np.float64)
            inner = np.sqrt(np.maximum(batch.column("norm").to_numpy() + float(index.most) - 2 * best, 0))[:, None] - index.slack
            search, tile = np.nonzero((least > done) & (least <= now) & (greatest >= inner))
            part = batch.column("qid").to_numpy() % slices
            for low in range(0, len(search), 1000):
                rows = pa.array(search[low : low + 1000])
                columns = [batch.column(c).take(rows) for c in ("qid", "label", "vector", "lows", "highs")]
                yield pa.RecordBatch.from_arrays([pa.array(tile[low : low + 1000].astype(np.int32)), pa.array(part[search[low : low + 1000]].astype(np.int32)), *columns], ["tile", "slice", "qid", "label", "vector", "lows", "highs"])

    return spread


def _scan(same: bool, k: int, exact_float: bool, dims: int):
    """Rows come by (tile, slice), entries before searches; each search takes the first k of each band in the tile."""
    kind = np.float64 if exact_float else np.int64

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tile = None, [], None
        for batch in batches:
            tiles, slices, searches = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "slice", "search"))
            edges = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (slices[1:] != slices[:-1]) | (searches[1:] != searches[:-1])]) if len(tiles) else []
            for a, b in zip(edges, [*edges[1:], len(tiles)], strict=True):
                key, part = (tiles[a], slices[a]), batch.slice(a, b - a)
                if not searches[a]:
                    if key != at:
                        at, parts, tile = key, [], None
                    ids = part.column("ids").to_pylist()
                    parts.append((unpacked(part.column("vector"), dims).astype(kind), part.column("label").to_numpy(), ids))
                    continue
                if key != at:
                    continue
                if tile is None:
                    vectors, labels = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
                    ids = [i for p in parts for i in p[2]]
                    order = np.argsort([i[0] for i in ids], kind="stable")
                    tile, parts = (vectors[order].T.copy(), labels[order], [ids[i] for i in order]), []
                yield from _band_rows(part, tile, same, k, kind, dims)

    return scan


def _band_rows(part: pa.RecordBatch, tile: tuple, same: bool, k: int, kind: type, dims: int) -> Iterator[pa.RecordBatch]:
    entries, labels, ids = tile
    qids, own = (part.column(c).to_numpy() for c in ("qid", "label"))
    lows, highs = (part.column(c).to_pylist() for c in ("lows", "highs"))
    vectors = unpacked(part.column("vector"), dims).astype(kind)
    step = max(1, SCORES // max(1, entries.shape[1]))
    out: list[tuple] = []
    for start in range(0, len(qids), step):
        block = (vectors[start : start + step] @ entries).astype(np.int64)
        for j, scores in enumerate(block, start):
            right = (labels == own[j]) if same else (labels != own[j])
            held = np.flatnonzero(right & (scores >= min(lows[j])) & (scores <= max(highs[j])))
            held = held[np.argsort(-scores[held], kind="stable")]  # entries are by first id, so equal scores stay in that order
            descending = -scores[held]
            for band, (low, high) in enumerate(zip(lows[j], highs[j], strict=True)):
                a = np.searchsorted(descending, -high, "left")
                taken = held[a : min(a + k, np.searchsorted(descending, -low, "right"))]
                found = sorted((-int(scores[e]), i) for e in taken.tolist() for i in ids[e])[:k]
                out += [(int(qids[j]), band, -s, i) for s, i in found]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["qid", "band", "score", "id"])


def search(index: Index, queries: DataFrame, same: bool, k: int, first: float = FIRST, growth: float = GROWTH) -> DataFrame:
    """(qid, band, score, id): the first k ids of each band ``lows[i] .. highs[i]`` of scores, by score and then id.

    queries: qid, label, vector, norm, lows, highs; of entries with the query's
    label (``same``) or of the others.
    """
    held = {n: getattr(index, n) for n in ("pivots", "most", "dims", "tile_of", "pieces", "pivot", "low", "high", "rows")}
    slices = -(-max(1, queries.count()) // SLICE)
    copies = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    tiles = index.entries.select("tile", copies, F.lit(0).alias("search"), F.lit(None).cast("long").alias("qid"), "label", "vector", "ids", *(F.lit(None).cast("array<long>").alias(c) for c in ("lows", "highs")))
    state = queries.select("qid", "label", "vector", "norm", "lows", "highs", F.lit(-float("inf")).alias("reach"), F.lit(float("inf")).alias("needed"))
    columns = "qid long, label long, vector binary, norm long, lows array<long>, highs array<long>, reach double"
    found, share = None, first
    while True:
        state = cut(arrow_map(state, _extend(share, **held), f"{columns}, next double"))
        asks = arrow_map(state, _spread(slices, **held), "tile int, slice int, qid long, label long, vector binary, lows array<long>, highs array<long>")
        asks = asks.select("tile", "slice", F.lit(1).alias("search"), "qid", "label", "vector", F.lit(None).cast("array<long>").alias("ids"), "lows", "highs")
        met = tiles.unionByName(asks).repartition("tile", "slice").sortWithinPartitions("tile", "slice", "search")
        new = arrow_map(met, _scan(same, k, index.most < 1 << 53, index.dims), "qid long, band int, score long, id long")
        place = F.row_number().over(Window.partitionBy("qid", "band").orderBy(F.desc("score"), "id"))
        found = cut((new if found is None else found.unionByName(new)).withColumn("place", place).where(F.col("place") <= k).drop("place"))
        # A band that isn't full yet needs all down to its low end; a full one what can still be before its last.
        last = found.groupBy("qid", "band").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        ends = last.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("band", "last"))).alias("ends"))
        furthest = F.expr("array_min(transform(lows, (low, i) -> coalesce(ends[i], low)))").cast("double")
        needed = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(float(index.most)) - 2 * furthest)) + F.lit(2 * index.slack)
        state = state.join(ends, "qid", "left").withColumn("needed", needed).where(F.col("needed") > F.col("next"))
        state = state.select("qid", "label", "vector", "norm", "lows", "highs", F.col("next").alias("reach"), "needed")
        share *= growth
        if state.isEmpty():
            return found


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY, **options) -> DataFrame:
    """Hard negatives of each anchor and positive (columns of ``RESULT``)."""
    rows = prepare(embeddings)
    index = build(rows, **options)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    queries = cut(anchors.groupBy("label", "vector").agg(F.min("vec_id").alias("qid"), F.first("norm").alias("norm")))
    low, high = (F.array(F.lit(x).cast("long")) for x in (-index.most - 1, index.most))
    near = search(index, queries.select("*", low.alias("lows"), high.alias("highs")), True, TAKEN + 1)
    positives = near.groupBy("qid").agg(F.expr("transform(sort_array(collect_list(struct(-score, id))), x -> struct(-x.col1 AS score, x.id AS id))").alias("positives"))
    scores = F.expr("array_sort(array_distinct(transform(filter(positives, p -> p.score >= 0), p -> p.score)))")
    bands = cut(queries.join(positives, "qid").withColumn("highs", scores).withColumn("lows", F.expr("transform(highs, s -> (4 * s + 4) div 5)")))
    far = search(index, bands.where(F.size("highs") > 0).select("qid", "label", "vector", "norm", "lows", "highs"), False, TAKEN)
    negatives = far.groupBy("qid").agg(F.expr("sort_array(collect_list(struct(band, -score AS down, id)))").alias("negatives"))
    answers = bands.join(negatives, "qid").select("label", "vector", "positives", "highs", "negatives")

    met = anchors.join(answers, ["label", "vector"])
    # The anchor's own row isn't among its positives; any other row of its id and score is.
    met = met.withColumn("own", F.expr("array_position(positives, named_struct('score', norm, 'id', vec_id))"))
    met = met.withColumn("positive", F.explode(F.expr(f"slice(filter(positives, (p, i) -> i + 1 <> own), 1, {TAKEN})")))
    met = met.withColumn("chosen", F.expr("filter(negatives, n -> highs[n.band] = positive.score)"))
    met = met.select("vec_id", "positive", F.posexplode("chosen").alias("place", "negative"))
    return met.select(
        F.col("vec_id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"), (-F.col("negative.down")).alias("negative_score"),
    )


def op11_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "embeddings"))
