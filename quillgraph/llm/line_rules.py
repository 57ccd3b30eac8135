"""Operator 1, quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed; for
each host (``source``) the distinct documents (``doc_id``) that carry a line
are counted.  A line is frequent on a host if more than ``LEAST_DOCUMENTS`` of
its documents and more than ``SHARE_PERCENT`` per cent of them carry it; it is
removed from all of them.  A document with less than ``min_left`` of its words
left is depleted and rejected, as is one that fails the base rules.

With ``keep_first``, as in the pipeline, a frequent line stays in the host's
first document (smallest doc_id) that carries it, so a text with very many
copies on a host isn't lost altogether.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own; rows without a doc_id count as one document for each
text and are last in order; rows that repeat each get their own verdict; an
empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, cut, read

LEAST_DOCUMENTS = 8
SHARE_PERCENT = 4
MIN_LEFT = 0.3
MIN_WORDS = 50
MAX_REPEAT = 0.5
SYMBOLS = tk.byte_table(b"#*$%&|<>")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_spans(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that has a word: first byte, end, its first word, and each row's first line (with the total last)."""
    breaks = np.flatnonzero(buf == 10)
    before = np.searchsorted(breaks, starts)
    row = tk.owners(index)
    new = np.ones(len(starts), bool)
    new[1:] = (before[1:] != before[:-1]) | (row[1:] != row[:-1])
    word = np.flatnonzero(new)
    low = np.concatenate([[0], breaks + 1])[before[word]]
    high = np.concatenate([breaks, [len(buf)]])[before[word]]
    row = row[word]
    return np.maximum(low, offs[row]), np.minimum(high, offs[row + 1]), word, np.searchsorted(word, index)


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row; line hashes and words of each line that has a word; each row's first line."""
    inside = tk.NOT_SPACE[buf]
    starts, ends, index = tk.runs(inside, offs)
    row = tk.owners(index)
    word = tk.RangeHash(buf)(starts, ends)
    low, high, first, lines = line_spans(buf, offs, starts, index)
    raw = tk.RangeHash(buf)(low, high)
    line_row = tk.owners(lines)
    distinct, _ = tk.unique_per_row(line_row, raw)
    after = np.append(first[1:], len(starts))
    plain = tk.RangeHash(tk.LOWER[buf])(starts, ends)

    repeat = np.zeros(len(word), bool)
    if len(word) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        triple = tk.RangeHash(word)(at, at + 3) ^ tk.mix(row[at].astype(np.uint64) + tk.U64(1))
        order = np.argsort(triple)
        same = triple[order[1:]] == triple[order[:-1]]
        twice = at[np.concatenate([order[1:][same], order[:-1][same]])]
        for k in range(3):
            repeat[twice + k] = True
    return {
        "n_words": np.diff(index),
        "word_chars": tk.per_row(inside & ((buf & 0xC0) != 0x80), offs),
        "n_symbols": tk.per_row(SYMBOLS[buf], offs),
        "n_dup_lines": np.diff(lines) - np.bincount(distinct, minlength=len(offs) - 1),
        "n_repeat_words": tk.per_row(repeat, index),
        "lines": lines,
        "line_hash": tk.RangeHash(plain)(first, after).view(np.int64),
        "line_words": after - first,
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, buf, offs in tk.chunks(batch.column("text")):
            m = measure(buf, offs)
            lists = [pa.ListArray.from_arrays(pa.array(m["lines"], pa.int32()), pa.array(m[k], pa.int64())) for k in ("line_hash", "line_words")]
            part = batch.slice(start, stop - start)
            names = ["doc_id", "host", "text_hash", *COUNTS, "line_hash", "line_words"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names[:3]), *(pa.array(m[k], pa.int64()) for k in COUNTS), *lists], names)


def judge(documents: DataFrame, least: int = LEAST_DOCUMENTS, percent: float = SHARE_PERCENT, min_left: float = MIN_LEFT, keep_first: bool = False) -> DataFrame:
    """Counts and verdict of each document, with the words and hashes of the lines to remove.

    One pass over the texts leaves counts and line hashes; all else moves only
    these.  Line counts are partial sums, so a line that a third of all
    documents carry costs one row a task.
    """
    source = documents.select("doc_id", F.col("source").alias("host"), "text", F.xxhash64("text").alias("text_hash"))
    measured = cut(arrow_map(source, _measure_batches, "doc_id long, host string, text_hash long, " + ", ".join(f"{k} long" for k in COUNTS) + ", line_hash array<long>, line_words array<long>"))
    nameless = F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("nameless")
    each = cut(measured.groupBy("host", "doc_id", nameless).agg(F.array_distinct(F.flatten(F.collect_set("line_hash"))).alias("lines")))
    hosts = each.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("documents"))
    carried = each.select("host", "doc_id", F.explode("lines").alias("line"))
    counted = carried.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > least)
    limited = counted.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") * 100 > F.col("documents") * percent)
    frequent = cut(limited.select(F.xxhash64("host", "line").alias("mark"), "first_doc"))
    lines = measured.select("doc_id", "text_hash", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    lines = lines.select("doc_id", "text_hash", "host", F.xxhash64("host", "l.line_hash").alias("mark"), F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    gone = lines.join(frequent, "mark")
    if keep_first:
        gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    per_row = gone.groupBy("doc_id", "text_hash", "host").agg(F.sum("words").alias("gone_words"), F.collect_set("line").alias("gone_lines"), F.count(F.lit(1)).alias("gone_count"))
    per_row = per_row.select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), F.col("host").alias("k3"), "gone_words", "gone_lines", "gone_count")
    once = measured.groupBy("doc_id", "text_hash", "host").agg(F.count(F.lit(1)).alias("rows"), *(F.first(k).alias(k) for k in COUNTS))
    joined = once.join(per_row, once.doc_id.eqNullSafe(per_row.k1) & (once.text_hash == per_row.k2) & once.host.eqNullSafe(per_row.k3), "left")
    removed = (F.coalesce("gone_words", F.lit(0)) / F.col("rows")).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MAX_REPEAT))
    return joined.select(
        "doc_id", "host", "text_hash", *COUNTS, failed.alias("base_failed"),
        (~failed & (F.col("n_words") - removed >= F.col("n_words") * F.lit(min_left))).alias("kept"),
        (F.coalesce("gone_count", F.lit(0)) / F.col("rows")).cast("long").alias("n_lines_removed"), removed.alias("n_words_removed"), "gone_lines", "rows",
    )


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, gone in enumerate(batch.column("gone_lines").to_pylist()):
            if gone and texts[i]:
                lines = texts[i].split("\n")
                coded = [x.encode() for x in lines]
                m = measure(np.frombuffer("\n".join(lines).encode(), np.uint8), np.array([0, len("\n".join(lines).encode())]))
                marks, gone = iter(m["line_hash"].tolist()), set(gone)
                texts[i] = "\n".join(x for x, raw in zip(lines, coded, strict=True) if not raw.split() or next(marks) not in gone)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "lang", "source")), pa.array(texts, pa.string())], ["doc_id", "lang", "source", "text"])


def clean(documents: DataFrame, **limits: float) -> DataFrame:
    """The documents that are kept, without their frequent lines (columns of documents)."""
    verdict = judge(documents, **limits).where("kept").select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), F.col("host").alias("k3"), "gone_lines")
    keyed = documents.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash"))
    kept = keyed.join(verdict, keyed.doc_id.eqNullSafe(verdict.k1) & (keyed.text_hash == verdict.k2) & keyed.source.eqNullSafe(verdict.k3))
    stripped = arrow_map(kept.select("doc_id", "lang", "source", "text", "gone_lines"), _strip_batches, "doc_id long, lang string, source string, text string")
    return stripped.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"))
    columns = ["doc_id", *COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_removed"]
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")
