"""Operator 3, document fingerprints: threshold-scaled sketch.

A sketch keeps every distinct 64-bit hash of a 5-word shingle that lies below
``2**64 / SCALE``.  Which hashes are kept depends on the hash alone, so the
sketch of a union is the union of the sketches, and the share of one sketch
found in another estimates containment also between very unequal documents.
A text whose hashes all lie above the threshold keeps its smallest one, which
is as mergeable: a union keeps what is below, else the smallest.

The likeness of a document to another text is the containment of its sketch
in the other's, ``|A & B| / |A|``: 1 for two empty sketches, 0 for one empty
one.  ``resemblance`` estimates ``|A & B| / |A | B|`` from the same sketches.

The fingerprint is written as base64 of the ascending hashes, 8 bytes each,
high byte first; no words give the empty string.

Defined cases: a null text is empty; fewer than five words are one shingle;
equal texts have equal fingerprints; in descending order of doc_id, rows that
repeat a doc_id follow in the order of their text (null first), and rows with
a null doc_id come after all others; a single row is its own next document;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, read

SHINGLE = 5
SCALE = 8
ROWS_EACH = 50_000


def sketches(column: pa.Array, size: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """Ascending distinct hashes kept for each text."""
    out: list[np.ndarray] = []
    most = np.uint64(((1 << 64) - 1) // scale)
    for _, _, buf, offs in tk.chunks(column):
        starts, ends, index = tk.runs(tk.NOT_SPACE[buf], offs)
        row = tk.owners(index)
        word = tk.RangeHash(buf)(starts, ends)
        at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
        count = np.diff(index)
        short = np.flatnonzero((count > 0) & (count < size))
        spans = tk.RangeHash(word)
        hashes = np.concatenate([spans(at, at + size), spans(index[short], index[short + 1])])
        of = np.concatenate([row[at], short])
        low = hashes <= most
        missing = np.ones(len(count), bool)
        missing[of[low]] = False
        missing &= count > 0
        if missing.any():
            rest = np.flatnonzero(missing[of])
            least = np.full(len(count), np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, of[rest], hashes[rest])
            low[rest] = hashes[rest] == least[of[rest]]
        of, hashes = tk.unique_per_row(of[low], hashes[low])
        out += np.split(hashes, np.cumsum(np.bincount(of, minlength=len(count)))[:-1])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's sketch that is in b's."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both <= np.uint64(((1 << 64) - 1) // scale)]
    return low if len(low) else both[:1]


def encoded(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def half_replaced(text: str, other: str) -> str:
    """The last half of the code points replaced by the other text's first as many (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, then order; each is compared with the next one of its block, a halo row only being read."""
    held: tuple | None = None
    ready: list[tuple] = []

    def flush() -> pa.RecordBatch:
        ids, texts, own, following, nexts = (list(x) for x in zip(*ready, strict=True))
        ready.clear()
        edited = [half_replaced(t, n) for t, n in zip(texts, following, strict=True)]
        other = sketches(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([encoded(s) for s in own], pa.string()), pa.array([encoded(s) for s in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, nexts, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            own = sketches(part.column("text"))
            texts = [t or "" for t in part.column("text").to_pylist()]
            for block, doc, halo, text, sketch in zip(part.column("block").to_pylist(), part.column("doc_id").to_pylist(), part.column("halo").to_pylist(), texts, own, strict=True):
                if held is not None and held[0] == block and not held[2]:
                    ready.append((held[1], held[3], held[4], text, sketch))
                held = (block, doc, halo, text, sketch)
            if ready:
                yield flush()


def compare_next(documents: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness and that to the next document.

    Blocks of neighbouring doc_ids, cut at approximate quantiles, are sorted on
    their own; the first row of the following block is sent along as a halo, so
    each text moves once, and only one a block twice.  The driver sees one cut
    point and one doc_id a block.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    total, empty_ids = documents.select(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_each))
    cuts = np.array(sorted(set(documents.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if total > empty_ids else [], np.int64)

    @F.arrow_udf("int")
    def block(ids: pa.Array, absent: pa.Array) -> pa.Array:
        """Blocks count upwards in descending order of doc_id; rows without one form the last."""
        number = len(cuts) - np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(absent.to_numpy(zero_copy_only=False), len(cuts) + 1, number).astype(np.int32))

    # Nulls are passed as a flag, as numpy would make the ids floating-point numbers.
    number, absent = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()
    placed = rows.withColumn("block", block(number, absent))
    firsts = placed.groupBy("block").agg(F.max("doc_id").alias("doc_id")).orderBy("block").collect()
    # The first rows of a block are also wanted at the end of the one before; those of the first block at the end of the last.
    numbers = np.array([r.block for r in firsts], np.int64)
    before = np.roll(numbers, 1)
    leading = np.array([r.doc_id or 0 for r in firsts], np.int64)

    @F.arrow_udf("array<int>")
    def targets(own: pa.Array, ids: pa.Array) -> pa.Array:
        own = own.to_numpy(zero_copy_only=False)
        at = np.searchsorted(numbers, own)
        first = ids.to_numpy(zero_copy_only=False) == leading[at]
        return pa.array([[a, b] if f else [a] for a, b, f in zip(own.tolist(), before[at].tolist(), first.tolist(), strict=True)], pa.list_(pa.int32()))

    dealt = placed.select("doc_id", "text", F.posexplode(targets("block", number)).alias("k", "block"))
    dealt = dealt.select("doc_id", "text", "block", (F.col("k") > 0).alias("halo")).repartition(max(1, len(firsts)), "block")
    ordered = dealt.sortWithinPartitions("block", "halo", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return arrow_map(ordered, _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(read(spark, sf_dir, "documents"))
