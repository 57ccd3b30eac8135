"""Operator 5, suffix-array dedup: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

Every byte covered by a ``WINDOW``-byte string that also starts elsewhere is
removed.

1. *Runs.*  The least hash of the ``GRAM``-byte strings inside a window is its
   anchor (leftmost on ties).  The anchor depends on the window's bytes alone,
   so equal windows have equal anchors at equal places.  Neighbouring starts
   with one anchor are a run; windows can only be equal in runs with equal
   anchor strings.  Runs whose anchor string occurs once are done.
2. *Collapse.*  Runs with the same bytes are one segment with a multiplicity.
3. *Merge.*  Segments with the same anchor meet in one task.  Each shard of
   segments has its own suffix order and transform over the alphabet of
   ``BLOCK``-byte strings (all byte positions are suffixes; the symbol that
   precedes a suffix is the block that ends where it starts).  The interleave
   of the shards starts as their concatenation; each iteration deals its
   positions to buckets by the preceding symbol, which sorts it by one more
   block, and marks the boundaries that appear, from which common prefixes
   follow.  After WINDOW / BLOCK iterations the stretches without a boundary
   are the repeated intervals; a suffix is repeated if its interval has more
   than one occurrence.  Suffixes are sorted in their own shard only.
4. *Spans.*  Repeated starts are carried back from segments to all their runs
   and to documents, and the text is cut.

An anchor with more than ``HOT`` different segments (a line that very many
documents share) isn't gathered: its runs are cut into aligned blocks of
starts, halved as long as a block's common bytes still occur more than once,
with partially summed counts in place of groups, down to single starts.

Blocks, segments and windows are compared by 64-bit hashes.

Defined cases: a null or empty text has 0 bytes and the hash of nothing; a
text shorter than a window is kept; repeated rows are copies of one another
and lose all windows; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, bitmap, cut, marked, partitions_for, read

WINDOW = 400
GRAM = 32
BLOCK = 100
HOT = 500
SHARDS = 4
#: Bytes of segments merged at once in a task.
BATCH_BYTES = 1 << 19
FIRST_BLOCK = 128
_PLACE = np.uint64(28)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each stretch of ``width``, from minima towards both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first start in the row, number of starts, anchor's distance from the first start, anchor hash, segment hash of each run."""
    spans = tk.RangeHash(buf)
    if len(buf) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    place = np.arange(len(buf) - GRAM + 1)
    gram = spans(place, place + GRAM)
    ordered = (gram >> _PLACE << _PLACE) | place.astype(np.uint64)
    anchor = (sliding_least(ordered, WINDOW - GRAM + 1) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    row = np.searchsorted(offs, np.arange(len(anchor)), "right") - 1
    start = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= offs[row + 1])
    row, anchor = row[start], anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, lead = start[first], anchor[first] - start[first]
    segment = spans(begin, begin + count - 1 + WINDOW) ^ tk.mix((lead.astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64))
    return row[first], begin - offs[row[first]], count, lead, gram[anchor[first]], segment


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, buf, offs in tk.chunks(batch.column("text")):
            row, begin, count, lead, anchor, segment = find_runs(buf, offs)
            if len(row):
                part, at = batch.slice(start, stop - start), pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("text_hash").take(at), *(pa.array(x, pa.int32()) for x in (begin, count, lead)), *(pa.array(x.view(np.int64)) for x in (anchor, segment))],
                    ["doc_id", "text_hash", "begin", "n", "lead", "anchor", "segment"],
                )


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers: one sort of (symbol, place) packed into 64 bits."""
    bits = max(1, int(len(symbols) - 1).bit_length())
    return np.sort((symbols.astype(np.uint64) << np.uint64(bits)) | np.arange(len(symbols), dtype=np.uint64)).astype(np.int64) & ((1 << bits) - 1)


class ShardTransform:
    """Suffix order and transform of a shard: positions of a range of the text, over block symbols.

    ``first`` has the block symbol at each position (0: fewer than BLOCK bytes
    are left, the end mark) and ``before`` that of the block which ends there.
    The order is by the first ``depth`` blocks, which is all a merge to that
    depth needs.
    """

    def __init__(self, first: np.ndarray, before: np.ndarray, depth: int, block: int):
        order = np.arange(len(first))
        ended = np.append(first, np.zeros(block * depth, first.dtype))
        for k in range(depth - 1, -1, -1):
            # A suffix that has ended has end marks only.
            alive = np.ones(len(order), bool)
            for j in range(k):
                alive &= ended[order + j * block] > 0
            order = order[stable_order(np.where(alive, ended[order + k * block], 0))]
        self.order, self.transform = order, before[order]


def merge_transforms(shards: list[ShardTransform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave (shard of each merged place), interval number and common prefix (in blocks, with the place before) of each place."""
    interleave = np.repeat(np.arange(len(shards), dtype=np.int8), [len(s.order) for s in shards])
    interval = np.zeros(len(interleave), np.int64)
    common = np.full(len(interleave), depth, np.int8)
    symbols = np.empty(len(interleave), np.int64)
    for step in range(depth):
        for k, shard in enumerate(shards):
            symbols[interleave == k] = shard.transform
        order = stable_order(symbols)
        interleave, interval, ranked = interleave[order], interval[order], symbols[order]
        boundary = np.ones(len(order), bool)
        boundary[1:] = (ranked[1:] != ranked[:-1]) | (interval[1:] != interval[:-1]) | (ranked[1:] == 0)
        common = np.where(boundary, np.minimum(common, step), common)
        interval = np.cumsum(boundary)
    return interleave, interval, common


def repeated_starts(segments: list[bytes], weights: np.ndarray, shards: int = SHARDS, window: int = WINDOW, block: int = BLOCK) -> list[np.ndarray]:
    """For each segment whether the window at each of its starts occurs more than once, segments counting by their weight."""
    depth = window // block
    size = np.array([len(s) for s in segments])
    # One position more than bytes: the end of a segment is a suffix too.
    base = np.r_[0, np.cumsum(size + 1)]
    buf = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(segments)), size + 1)
    place = np.arange(len(buf))
    whole = place + block <= base[owner] + size[owner]
    first = np.zeros(len(buf), np.int64)
    full = np.flatnonzero(whole)
    first[full] = np.unique(tk.RangeHash(buf)(full, full + block), return_inverse=True)[1] + 1
    before = np.zeros(len(buf), np.int64)
    inner = np.flatnonzero(place - block >= base[owner])
    before[inner] = first[inner - block]
    cuts = np.unique(np.searchsorted(base, np.linspace(0, base[-1], shards + 1)[1:-1]))
    edges = base[np.unique(np.r_[0, cuts, len(segments)])]
    parts = [ShardTransform(first[a:b], before[a:b], depth, block) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    interleave, interval, _ = merge_transforms(parts, depth)
    merged = np.empty(len(buf), np.int64)
    for k, part in enumerate(parts):
        merged[np.flatnonzero(interleave == k)] = part.order + edges[k]
    total = np.bincount(interval, weights[owner[merged]])
    twice = np.empty(len(buf), bool)
    twice[merged] = total[interval] > 1
    return [twice[b : b + max(0, n - window + 1)] for b, n in zip(base[:-1].tolist(), size.tolist(), strict=True)]


def stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the True runs."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2].tolist(), edge[1::2].tolist()


_FOUND = ["anchor", "segment", "low", "high"]


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, segment); anchors are worked off together until BATCH_BYTES are reached."""
    held: list[tuple[int, int, int, bytes]] = []
    held_bytes = 0

    def flush() -> pa.RecordBatch:
        nonlocal held_bytes
        flags = repeated_starts([h[3] for h in held], np.array([h[2] for h in held], np.float64))
        rows = [(h[0], h[1], *stretches(f)) for h, f in zip(held, flags, strict=True) if f.any()]
        held.clear()
        held_bytes = 0
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _FOUND)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "weight", "bytes")), strict=True):
            if held and held[-1][:2] == row[:2]:  # a repeated row of documents
                continue
            if held_bytes >= BATCH_BYTES and held[-1][0] != row[0]:
                yield flush()
            held.append(row)
            held_bytes += len(row[3])
    if held:
        yield flush()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound the Python objects that are made of one."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[tuple] = []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
            out += [(r["anchor"], r["segment"], r["weight"], r["lead"], r["hot"], text[r["begin"] : r["begin"] + r["n"] - 1 + WINDOW]) for r in runs]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "segment", "weight", "lead", "hot", "bytes"])


_BLOCK = "anchor long, segment long, weight long, offset int, n int, core long, piece long"


def _halver(half: int):
    """Cut the open pieces of each segment into the aligned blocks of ``half`` starts, with hashes of the blocks' common bytes and of all their bytes."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(x.split() for x in _BLOCK.split(", ")), strict=True)
        for batch in slices(batches):
            out: list[tuple] = []
            for anchor, segment, lead, pieces, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "lead", "pieces", "bytes")), strict=True):
                blocks = []
                for p in pieces:
                    # The distance to the anchor falls by one with each start.
                    first, last = p["offset"], p["offset"] + p["n"] - 1
                    blocks += [(number, max(lead - number * half - half + 1, first), min(lead - number * half, last), p["weight"]) for number in range((lead - last) // half, (lead - first) // half + 1)]
                number, low, high, weight = map(np.array, zip(*blocks, strict=True))
                hashed = tk.RangeHash(np.frombuffer(raw, np.uint8))
                core = lead - number * half
                mark = (number * 1024 + half).astype(np.uint64) + np.uint64(anchor & 0xFFFFFFFFFFFFFFFF)
                core = tk.mix(hashed(core, core + WINDOW - half + 1) ^ tk.mix(mark))
                piece = hashed(low, high + WINDOW) ^ (lead - low).astype(np.uint64)
                out += zip([anchor] * len(low), [segment] * len(low), weight.tolist(), low.tolist(), (high - low + 1).tolist(), core.view(np.int64).tolist(), piece.view(np.int64).tolist(), strict=True)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            arrow = {"long": pa.int64(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(columns, types, strict=True)], list(names))

    return halve


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a segment that touch become one."""
    for batch in batches:
        spans = [merged(p) for p in batch.column("pieces").to_pylist()]
        lists = [pa.array([[s[k] for s in row] for row in spans], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("segment"), *lists], _FOUND)


def halved(hot: DataFrame) -> DataFrame:
    """Repeated starts of the segments with a hot anchor, by halving blocks of starts.

    Blocks are counted by their hashes; bytes stay with their segment, of which
    only those with open pieces go on to the next round.
    """
    hot = cut(hot.dropDuplicates(["anchor", "segment"]).select("anchor", "segment", "weight", "lead", "bytes"))
    whole = F.struct(F.lit(0).alias("offset"), (F.octet_length("bytes") - (WINDOW - 1)).alias("n"), "weight")
    pieces = hot.select("anchor", "segment", "lead", "bytes", F.array(whole).alias("pieces"))
    found, half = None, FIRST_BLOCK
    while True:
        blocks = cut(arrow_map(pieces, _halver(half), _BLOCK))
        # Cut, so that the joins read both sides from exchanges and a core of very many blocks is split.
        cores = cut(blocks.groupBy("core").agg(F.sum("weight").alias("core_weight")).where("core_weight > 1"))
        same = cut(blocks.groupBy("core", "piece").agg(F.sum("weight").alias("piece_weight")).where("piece_weight > 1"))
        counted = cut(blocks.join(cores, "core").join(same, ["core", "piece"], "left"))
        done = counted.where("piece_weight > 1" if half > 1 else "true").select("anchor", "segment", F.struct(F.col("offset").alias("low"), (F.col("offset") + F.col("n")).alias("high")).alias("piece"))
        found = done if found is None else found.unionByName(done)
        if half == 1:
            break
        # Of pieces with the same bytes one goes on, for what it may share with others.
        going = counted.dropDuplicates(["core", "piece"]).select("anchor", "segment", F.struct("offset", "n", F.coalesce("piece_weight", "weight").alias("weight")).alias("piece"))
        going = cut(going.groupBy("anchor", "segment").agg(F.collect_list("piece").alias("pieces")))
        if going.isEmpty():
            break
        still = marked(hot, bitmap(going.select("anchor", "segment")), "anchor", "segment").where("marked")
        pieces = still.select("anchor", "segment", "lead", "bytes").join(going, ["anchor", "segment"])
        half //= 2
    # A segment has no more pieces than starts.
    pieces = found.groupBy("anchor", "segment").agg(F.collect_list("piece").alias("pieces"))
    return arrow_map(pieces, _join_batches, "anchor long, segment long, low array<int>, high array<int>")


def _row() -> Column:
    return F.struct("doc_id", "text_hash").alias("row")


def segments_of(keyed: DataFrame, live: DataFrame) -> DataFrame:
    """Bytes of the live segments, each from the one row of documents that it names; other texts aren't shuffled."""
    wanted = live.groupBy(_row()).agg(F.collect_list(F.struct("anchor", "segment", "weight", "begin", "n", "lead", "hot")).alias("runs"))
    texts = marked(keyed, bitmap(live.select("doc_id", "text_hash").distinct()), "doc_id", "text_hash").where("marked").select(_row(), "text")
    return arrow_map(texts.join(wanted, "row").select("text", "runs"), _segment_batches, "anchor long, segment long, weight long, lead int, hot boolean, bytes binary")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """row (doc_id, text_hash) and spans (array of low, high in bytes, which may overlap) of the documents that have any."""
    spark = documents.sparkSession
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    runs = cut(arrow_map(keyed, _run_batches, "doc_id long, text_hash long, begin int, n int, lead int, anchor long, segment long"))
    twice = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("anchor")
    # All runs of a marked anchor are there, so counts are whole; an anchor marked by chance goes by its total.
    alive = marked(runs, bitmap(twice), "anchor").where("marked")
    kept = alive.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "text_hash", "begin", "n", "lead")).alias("r"))
    totals = kept.groupBy("anchor").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    live = cut(kept.join(totals, "anchor").select("anchor", "segment", "weight", "r.*", (F.col("kinds") > HOT).alias("hot")))
    sizes = live.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.max("hot"), F.lit(False)).alias("hot")).first()
    parts = partitions_for(spark, sizes.segments, 20_000)
    plain = segments_of(keyed, live.where("NOT hot")).select("anchor", "segment", "weight", "bytes")
    found = arrow_map(plain.repartition(parts, "anchor").sortWithinPartitions("anchor", "segment"), _merge_batches, "anchor long, segment long, low array<int>, high array<int>")
    if sizes.hot:
        found = found.unionByName(halved(segments_of(keyed, live.where("hot"))))
    found = cut(found)
    repeated = marked(runs, bitmap(found.select("anchor", "segment")), "anchor", "segment").where("marked")
    spans = repeated.join(found, ["anchor", "segment"]).select("doc_id", "text_hash", "begin", F.explode(F.arrays_zip("low", "high")).alias("s"))
    spans = spans.select(_row(), F.struct((F.col("begin") + F.col("s.low")).alias("low"), (F.col("begin") + F.col("s.high") - 1 + WINDOW).alias("high")).alias("span"))
    return spans.groupBy("row").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cutter(with_kept: bool):
    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            spans = [merged(s) for s in part.column("spans").to_pylist()]
            kept = [without(t, s) for t, s in zip(texts, spans, strict=True)]
            gone = [len(t) - len(k) for t, k in zip(texts, kept, strict=True)]
            columns = {"doc_id": part.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(map(len, spans), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
            columns |= {"kept": pa.array(kept, pa.binary())} if with_kept else {}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cut_batches


def remove_repeats(documents: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and on request the kept bytes of each document.

    Only texts that lose bytes meet their spans in a shuffle; the others are answered where they are read.
    """
    spans = cut(repeated_spans(documents))
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    either = marked(keyed, cut(bitmap(spans.select("row.doc_id", "row.text_hash"))), "doc_id", "text_hash")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    losing = arrow_map(either.where("marked").select("doc_id", _row(), "text").join(spans, "row", "left").select("doc_id", "text", "spans"), _cutter(with_kept), schema)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    none = F.lit(0).cast("long")
    whole = either.where("NOT marked").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] * with_kept))
    return losing.unionByName(whole)


def op5_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_kept=False)
