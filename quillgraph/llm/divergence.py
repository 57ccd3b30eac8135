"""Operator 13, source divergence audit by sort-based streaming.

Each task sorts the (lang, term, source, document) keys of a stretch of its
documents and scans the runs, which gives partial document frequencies and
counts; documents lie in one task each, so the partial ones add up.  Partial
runs are dealt by (lang, term, source), sorted within partitions with the
document last (and the term first, whose leading bytes tell most rows apart),
and scanned again; then the runs of a (lang, term) meet, one row
a source, and terms in at least ``LEAST_DOCUMENTS`` of a language's documents
are kept.  So a word of every document moves as one row a source and stretch,
and no task gets more rows of a term than there are stretches or sources.

Smoothed shares p come from counts by exact integer arithmetic.  A last scan
over (lang, term, source) emits, for each run, partial values of the pairs of
sources that both have the term, and the terms of which a source has more than
its language (each task sends only the first ``TOP`` of a source).  What a pair
gets from terms that one or neither side has depends on the counts alone and is
summed over a source's distinct counts:

    value(s, t) = V f(0, 0) + sum of s's terms [f(c, 0) - f(0, 0)] + the same of t's
                  + sum of shared terms [f(c, d) - f(c, 0) - f(0, d) + f(0, 0)]

``f`` is the divergence of two counts' shares, so the result is whole without a
row for each term that a source lacks.

Defined cases: null text, lang and source count as ''; every row is a document,
also one that repeats another; a source without terms has pairs but no terms; a
language without kept terms has pairs of value 0; a lone source has no pairs;
equal values are ranked by item; ``example_doc`` is the smallest doc_id of the
source's documents with the term (null: none has one); an empty table gives no
rows; further columns are dropped.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.frames import arrow_map, cut, read

LEAST_DOCUMENTS = 10
TOP = 10
#: Words that a task sorts at a time, and terms that it holds.
STRETCH, HELD = 3 << 20, 1 << 20
#: Sources whose pairs a task sums at a time.
SIDES = 1024
#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` as bytes of UTF-8, once A-Z are lower-case (``bytes.lower`` changes no other).
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _stretch_runs(keys: list[tuple[str, str, int | None]], words: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    """Partial runs of a stretch of documents: keys are (lang, source, doc_id), words the numbers of their terms."""
    order = sorted(range(len(keys)), key=lambda i: (*keys[i][:2], keys[i][2] is None, keys[i][2] or 0))
    group, number = np.zeros(len(order), np.int64), {}
    for k, i in enumerate(order):
        group[k] = number.setdefault(keys[i][:2], len(number))
    document = np.repeat(np.arange(len(order)), [len(words[i]) for i in order])
    key = np.concatenate([words[i] for i in order]) * len(order) + document
    key.sort()
    term, document = np.divmod(key, len(order))
    new_document = np.r_[True, key[1:] != key[:-1]]
    new_run = new_document & np.r_[True, (term[1:] != term[:-1]) | (group[document[1:]] != group[document[:-1]])]
    starts = np.flatnonzero(new_run)
    first = document[starts]
    langs, sources = (pa.array([name[k] for name in number], pa.string()) for k in (0, 1))
    ids = pa.array([keys[i][2] for i in order], pa.int64())
    of = pa.array(group[first])
    columns = [
        langs.take(of), pa.array([t.decode() for t in terms], pa.string()).take(pa.array(term[starts])), sources.take(of), ids.take(pa.array(first)),
        pa.array(np.add.reduceat(new_document.astype(np.int64), starts)), pa.array(np.diff(np.r_[starts, len(key)])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "document", "df", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[tuple] = []
    words: list[np.ndarray] = []
    held = 0
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    for batch in batches:
        for doc, text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source")), strict=True):
            found = TERM.findall(text.encode().lower())
            if found:
                keys.append((lang, source, doc))
                words.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
                held += len(found)
            if held >= STRETCH:
                yield _stretch_runs(keys, words, list(index))
                keys, words, held = [], [], 0
                index.clear()
    if held:
        yield _stretch_runs(keys, words, list(index))


def _complete(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows that are equal in ``by``, with the runs' starts; rows come sorted."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in by:
            column = table[name]
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        kept = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if kept is not None:
        yield kept, np.zeros(1, np.int64)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False)


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in _complete(batches, ("lang", "term", "source")):
        first = table.take(pa.array(starts))
        sums = [pa.array(np.add.reduceat(_numbers(table, c), starts)) for c in ("df", "n")]
        yield pa.RecordBatch.from_arrays([*(first[c].combine_chunks() for c in ("lang", "term", "source", "document")), *sums], ["lang", "term", "source", "document", "df", "n"])


def _keep(least: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _complete(batches, ("lang", "term")):
            sizes = np.diff(np.r_[starts, table.num_rows])
            df, total = (np.add.reduceat(_numbers(table, c), starts) for c in ("df", "n"))
            head = np.zeros(table.num_rows, np.int64)
            head[starts] = 1
            table = table.select(["lang", "term", "source", "document", "n"]).append_column("total", pa.array(np.repeat(total, sizes))).append_column("head", pa.array(head))
            yield from table.filter(pa.array(np.repeat(df >= least, sizes))).combine_chunks().to_batches()

    return keep


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Partials:
    """Partial values of pairs of sources and each source's foremost terms, for the runs of a task."""

    def __init__(self, top: int):
        self.top = top
        self._reset()

    def _reset(self) -> None:
        self.names: dict[tuple[str, str], int] = {}
        self.sums = np.zeros(SIDES * SIDES, np.int64)
        self.terms: list[list[tuple]] = []
        self.least = np.zeros(SIDES, np.int64)
        self.n_terms = 0

    def _number(self, lang: str, source: str) -> int:
        number = self.names.get((lang, source))
        if number is None:
            number = self.names[lang, source] = len(self.names)
            self.terms.append([])
        return number

    def add(self, lang: str, term: str, sources: list[str], documents: list[int | None], p: np.ndarray, p0: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One run; yields what is held when another source or term wouldn't fit."""
        half = SIDES // 2
        for i in range(0, len(sources), half):
            for j in range(i, len(sources), half):
                own = list(range(i, min(i + half, len(sources))))
                rows = own if i == j else own + list(range(j, min(j + half, len(sources))))
                if len(self.names) + len(rows) > SIDES and any((lang, sources[k]) not in self.names for k in rows):
                    yield self.emit()
                number = np.array([self._number(lang, sources[k]) for k in rows])
                self._pairs(number, p[rows], p0[rows], len(own) if i != j else 0)
                if i == j:
                    self._foremost(number, term, [documents[k] for k in rows], p[rows], q[rows])
        if self.n_terms > HELD:
            self.trim()
            if self.n_terms > HELD // 2:
                yield self.emit()

    def _pairs(self, number: np.ndarray, p: np.ndarray, p0: np.ndarray, own: int) -> None:
        """Add the run's part of all pairs, or (``own``) of those of the first rows with the others."""
        a, b = (x.ravel() for x in np.meshgrid(np.arange(own), np.arange(own, len(p)), indexing="ij")) if own else _corner(len(p))
        pa_, pb, za, zb = p[a], p[b], p0[a], p0[b]
        value = divergence(pa_, pb) - divergence(pa_, zb) - divergence(za, pb) + divergence(za, zb)
        np.add.at(self.sums, np.minimum(number[a], number[b]) * SIDES + np.maximum(number[a], number[b]), value)

    def _foremost(self, number: np.ndarray, term: str, documents: list[int | None], p: np.ndarray, q: np.ndarray) -> None:
        more = p - q
        value = more * more // (p + q)
        for k in np.flatnonzero((more > 0) & (value >= self.least[number])).tolist():
            held = self.terms[number[k]]
            held.append((-int(value[k]), term, documents[k]))
            self.n_terms += 1
            if len(held) >= 8 * self.top:
                self.n_terms -= len(held) - self.top
                self._first(held)
                self.least[number[k]] = -held[-1][0]

    def _first(self, held: list[tuple]) -> None:
        held.sort(key=lambda x: x[:2])
        del held[self.top :]

    def trim(self) -> None:
        for held in self.terms:
            self._first(held)
        self.n_terms = sum(map(len, self.terms))

    def emit(self) -> pa.RecordBatch:
        self.trim()
        names = list(self.names)
        rows = [(*group, "term", term, -value, document) for group, held in zip(names, self.terms, strict=True) for value, term, document in held]
        for at in np.flatnonzero(self.sums).tolist():
            (lang, a), (_, b), value = names[at // SIDES], names[at % SIDES], int(self.sums[at])
            rows += [(lang, a, "pair", b, value, None), (lang, b, "pair", a, value, None)]
        self._reset()
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "source", "part", "item", "value", "example_doc"])


@functools.lru_cache(maxsize=64)
def _corner(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _compare(top: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = Partials(top)
        for table, starts in _complete(batches, ("lang", "term")):
            lang, term, source, document = (table[c].to_pylist() for c in ("lang", "term", "source", "document"))
            p, p0, q = (_numbers(table, c) for c in ("p", "p0", "q"))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                yield from partials.add(lang[a], term[a], source[a:b], document[a:b], p[a:b], p0[a:b], q[a:b])
        yield partials.emit()

    return compare


def _share(count: str, total: str) -> Column:
    """Smoothed share in parts of 10**9, of counts of any size; null without kept terms."""
    return F.expr(f"CASE WHEN terms > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(38, 0)) * ({count} + 2)) div (CAST({total} AS DECIMAL(38, 0)) + 2 * terms) END")


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Divergence of each source from the others of its language, and the terms it uses more than its language does."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    run = "lang string, term string, source string, document long"
    partial = arrow_map(rows, _count, f"{run}, df long, n long")
    last = F.asc_nulls_last("document")
    summed = arrow_map(partial.repartition("lang", "term", "source").sortWithinPartitions("term", "lang", "source", last), _sum_runs, f"{run}, df long, n long")
    kept = cut(arrow_map(summed.repartition("lang", "term").sortWithinPartitions("term", "lang", "source"), _keep(least), f"{run}, n long, total long, head long"))

    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("lang_size"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = cut(groups.fillna(0, ["size", "terms", "lang_size"]).withColumn("p0", _share("0", "size")))

    facts = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "size")).withColumn("q", _share("total", "lang_size"))
    scanned = facts.select("lang", "term", "source", "document", "p", "p0", "q").repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    schema = "lang string, source string, part string, item string, value long, example_doc long"
    shared = arrow_map(scanned, _compare(top), schema)

    counts = facts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    own = groups.select("lang", "source", "terms", "p0").join(counts, ["lang", "source"], "left")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("r0"))
    alone = own.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.expr(f"coalesce(sum(times * ({_divergence('p', 'r0')} - {_divergence('p0', 'r0')})), 0)").alias("one_side"),
        F.expr(f"coalesce(first(terms * {_divergence('p0', 'r0')}), 0)").alias("neither"),
    )
    ways = F.explode(F.array(F.struct("source", "item", (F.col("one_side") + F.col("neither")).alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("one_side").alias("value"))))
    alone = alone.select("lang", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "way.value", F.lit(None).cast("long").alias("example_doc"))

    whole = shared.unionByName(alone).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"), F.min("example_doc").alias("example_doc"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = whole.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank", "example_doc")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))
