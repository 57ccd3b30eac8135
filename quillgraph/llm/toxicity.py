"""Operator 4, toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms (A-Z lower-cased runs of letters and
digits).  Besides a weight for each term, the machine has a vector for each,
and the product of two vectors weighs the two terms occurring together, such
as an insult with the mention of a group:

    logit = w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

The pair sum is taken in linear time as half of |sum v|^2 - sum |v|^2.  It is
fitted by AdaGrad on the driver, from at most ``MAX_ROWS`` labelled documents
(those with the smallest seeded hash of doc_id) of which only hashed terms are
collected; documents whose crc32(doc_id) mod 5 is 0 are held out.  Rare words
would be learned by heart, so parameters go to two kinds of terms only, found
on the sample: those that at least ``MIN_TERM_ROWS`` documents have and whose
toxic share stands out by ``MIN_Z`` standard errors; and those that may say
nothing alone, but are one of a pair that interacts.  For the latter, pairs are
held against an additive model: the log odds ratio of one term with the other
present against that with it absent, which has to depart from 1 by
``MIN_PAIR_Z`` standard errors, and more where very many pairs are tried.  This
is done for the ``PAIR_TERMS`` most frequent terms over the whole sample, and
for all terms in at least ``MIN_PAIR_ROWS`` documents over as many different
documents of it as ``PAIR_WORK`` allows.  Every document is scored, over its
whole text.

Defined cases: a null or empty text has no terms and gets the score of the
bias alone; a null doc_id counts as the empty text, is held out and can't be
labelled; a doc_id with several labels is toxic if any says so, and of its
rows one is fitted; a null label is no label; repeated rows get equal scores;
without any usable label, or with one class only, the bias is the smoothed
share of toxic labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, read

BITS = 18
FACTORS = 8
MAX_ROWS = 30_000
MIN_TERM_ROWS = 3
MIN_Z = 4.0
PAIR_TERMS = 1024
MIN_PAIR_ROWS = 20
#: A pair interacts if it is off by this many standard errors at least, and by so many that of all pairs tried one is off by chance in ``PAIR_CHANCE`` cases.
MIN_PAIR_Z, PAIR_CHANCE = 5.0, 0.05
#: Bound of the sample for pairs: the rows' numbers of terms, squared, come to no more.
PAIR_WORK = 2e9
EPOCHS = 20
SEED = 17
TERM = tk.byte_table(b"abcdefghijklmnopqrstuvwxyz0123456789") | (np.arange(256) >= 128)


def term_sets(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed term) pairs of a chunk, in order."""
    low = tk.LOWER[buf]
    starts, ends, index = tk.runs(TERM[low], offs)
    bucket = (tk.RangeHash(low)(starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.sort((tk.owners(index) << bits) | bucket)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Machine:
    """Bias, weights (dims) and factors (dims, k) as 32-bit floats."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Of rows given as ascending (row, term) pairs."""
        out = self.bias + np.bincount(row, self.weights[term], minlength=rows)
        used = np.flatnonzero(self.factors[term].any(axis=1))
        if len(used):
            row, v = row[used], self.factors[term[used]].astype(np.float64)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += 0.5 * (np.add.reduceat(v, first) ** 2 - np.add.reduceat(v * v, first)).sum(axis=1)
        return out

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(row, term, rows), -30, 30)))


def informative(row: np.ndarray, term: np.ndarray, toxic: np.ndarray, bits: int) -> np.ndarray:
    """Terms in enough rows whose share of toxic rows departs from the overall share by ``MIN_Z`` standard errors."""
    count = np.bincount(term, minlength=1 << bits)
    share = toxic.mean()
    excess = np.bincount(term, toxic[row], 1 << bits) - count * share
    return (count >= MIN_TERM_ROWS) & (np.abs(excess) >= MIN_Z * np.sqrt(np.maximum(count, 1) * share * (1 - share)))


def interacting_frequent(row: np.ndarray, term: np.ndarray, toxic: np.ndarray, bits: int, rows_each: int = 2048, terms_each: int = 128) -> np.ndarray:
    """Terms, of the ``PAIR_TERMS`` most frequent, that form a pair whose toxic share no sum of two weights explains."""
    out = np.zeros(1 << bits, bool)
    count = np.bincount(term, minlength=1 << bits)
    chosen = np.flatnonzero((count >= MIN_PAIR_ROWS) & (count <= len(toxic) - MIN_PAIR_ROWS))
    chosen = chosen[np.lexsort((chosen, -count[chosen]))][:PAIR_TERMS]
    place = np.full(1 << bits, -1)
    place[chosen] = np.arange(len(chosen))
    both, both_toxic = (np.zeros((len(chosen), len(chosen)), np.float32) for _ in range(2))
    for low in range(0, len(toxic), rows_each):
        a, b = np.searchsorted(row, (low, low + rows_each))
        at = place[term[a:b]]
        has = np.zeros((min(rows_each, len(toxic) - low), len(chosen)), np.float32)
        has[row[a:b][at >= 0] - low, at[at >= 0]] = 1
        bad = has[toxic[low : low + rows_each] > 0]
        both += has.T @ has
        both_toxic += bad.T @ bad
    single, single_toxic = both.diagonal(), both_toxic.diagonal()
    for low in range(0, len(chosen), terms_each):
        part = slice(low, low + terms_each)
        n, t = both[part].astype(np.float64), both_toxic[part].astype(np.float64)
        ni, ti, nj, tj = single[part, None], single_toxic[part, None], single[None], single_toxic[None]
        cells = [(1, n, t), (-1, ni - n, ti - t), (-1, nj - n, tj - t), (1, len(toxic) - ni - nj + n, toxic.sum() - ti - tj + t)]
        contrast = sum(sign * (np.log(x + 0.5) - np.log(m - x + 0.5)) for sign, m, x in cells)
        error = np.sqrt(sum(1 / (x + 0.5) + 1 / (m - x + 0.5) for _, m, x in cells))
        strong = np.abs(contrast) >= MIN_PAIR_Z * error
        strong[np.arange(len(strong)), low + np.arange(len(strong))] = False
        out[chosen[part][strong.any(axis=1)]] = True
    return out


def interacting(row: np.ndarray, term: np.ndarray, toxic: np.ndarray, bits: int, terms_each: int = 32) -> np.ndarray:
    """Terms of any frequency of which a pair has a toxic share that no sum of two weights explains.

    All terms in ``MIN_PAIR_ROWS`` rows and more are met with all: for a block of
    terms at a time, rows with both are counted by summing the block's rows over
    the lists of the rows' terms.  Rows are those of ``told_apart``.
    """
    out = np.zeros(1 << bits, bool)
    row, term, toxic = told_apart(row, term, toxic)
    count = np.bincount(term, minlength=1 << bits)
    chosen = np.flatnonzero((count >= MIN_PAIR_ROWS) & (count <= len(toxic) - MIN_PAIR_ROWS))
    place = np.full(1 << bits, -1)
    place[chosen] = np.arange(len(chosen))
    at = place[term]
    row, at = row[at >= 0], at[at >= 0]
    terms = len(chosen)
    index = np.searchsorted(row, np.arange(len(toxic) + 1))
    single, single_toxic = np.bincount(at, minlength=terms).astype(float), np.bincount(at, toxic[row], terms)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(terms + 1))
    for low in range(0, terms, terms_each):
        high = min(low + terms_each, terms)
        n, t = (np.zeros((high - low, terms)) for _ in range(2))
        for k in range(low, high):
            rows = row[order[ends[k] : ends[k + 1]]]
            size = index[rows + 1] - index[rows]
            others = at[np.repeat(index[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            n[k - low] = np.bincount(others, minlength=terms)
            t[k - low] = np.bincount(others, np.repeat(toxic[rows], size), terms)
        ni, ti, nj, tj = single[low:high, None], single_toxic[low:high, None], single[None], single_toxic[None]
        cells = [(1, n, t), (-1, ni - n, ti - t), (-1, nj - n, tj - t), (1, len(toxic) - ni - nj + n, toxic.sum() - ti - tj + t)]
        contrast = sum(sign * (np.log(x + 0.5) - np.log(m - x + 0.5)) for sign, m, x in cells)
        error = np.sqrt(sum(1 / (x + 0.5) + 1 / (m - x + 0.5) for _, m, x in cells))
        strong = np.abs(contrast) >= least_pair_z(terms) * error
        strong[np.arange(high - low), np.arange(low, high)] = False
        out[chosen[low:high][strong.any(axis=1)]] = True
    return out


def told_apart(row: np.ndarray, term: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of each set of terms and label (copies are no further evidence), in order, as many as ``PAIR_WORK`` lets meet."""
    size = np.bincount(row, minlength=len(toxic))
    mark = np.zeros(len(toxic), np.uint64)
    np.add.at(mark, row, tk.mix((term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    _, first = np.unique(mark * np.uint64(2) + toxic.astype(np.uint64), return_index=True)
    first.sort()
    first = first[np.cumsum(size[first].astype(float) ** 2) <= PAIR_WORK]
    number = np.full(len(toxic), -1)
    number[first] = np.arange(len(first))
    kept = number[row] >= 0
    return number[row[kept]], term[kept], toxic[first]


def least_pair_z(terms: int) -> float:
    """Standard errors that none of all pairs of so many terms is off by chance, in ``PAIR_CHANCE`` cases: the normal law's tail, by its bound."""
    pairs = max(1, terms * (terms - 1) // 2)
    z = MIN_PAIR_Z
    while pairs * math.exp(-z * z / 2) / (z * math.sqrt(math.pi / 2)) > PAIR_CHANCE:
        z += 0.05
    return z


def fit(row: np.ndarray, term: np.ndarray, toxic: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 2e-4, batch: int = 128) -> Machine:
    """AdaGrad on the log loss; (row, term) pairs ascend by row.  The result depends on the arguments only."""
    rows, rng = len(toxic), np.random.default_rng(SEED)
    weights, factors = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, FACTORS), np.float32)
    share = (toxic.sum() + 0.5) / (rows + 1)
    machine = Machine(float(np.log(share / (1 - share))), weights, factors)
    if not rows or toxic.all() or not toxic.any():
        return machine
    seen = informative(row, term, toxic, bits) | interacting_frequent(row, term, toxic, bits) | interacting(row, term, toxic, bits)
    factors[seen] = rng.normal(0, 0.01, (int(seen.sum()), FACTORS))
    kept = seen[term]
    row, term = row[kept], term[kept]
    index = np.searchsorted(row, np.arange(rows + 1))
    past = [1e-6, np.full(1 << bits, 1e-6, np.float32), np.full((1 << bits, FACTORS), 1e-6, np.float32)]
    for _ in range(epochs):
        shuffled = rng.permutation(rows)
        for k in range(0, rows, batch):
            chosen = shuffled[k : k + batch]
            size = index[chosen + 1] - index[chosen]
            at = np.repeat(index[chosen] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            t, own = term[at], np.repeat(np.arange(len(chosen)), size)
            error = machine.scores(own, t, len(chosen)) - toxic[chosen]
            v = factors[t]
            sums = np.zeros((len(chosen), FACTORS))
            np.add.at(sums, own, v)
            step = error[own] / len(chosen)
            gradient = step[:, None] * (sums[own] - v)
            distinct, where = np.unique(t, return_inverse=True)
            g_w = np.bincount(where, step, len(distinct)) + decay * weights[distinct]
            g_v = np.stack([np.bincount(where, gradient[:, f], len(distinct)) for f in range(FACTORS)], axis=1) + decay * factors[distinct]
            g_0 = error.mean()
            past[0] += g_0**2
            past[1][distinct] += g_w**2
            past[2][distinct] += g_v**2
            machine.bias -= rate * g_0 / past[0] ** 0.5
            weights[distinct] -= rate * g_w / np.sqrt(past[1][distinct])
            factors[distinct] -= 0.2 * rate * g_v / np.sqrt(past[2][distinct])
    return machine


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5))


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, buf, offs in tk.chunks(batch.column("text")):
            row, term = term_sets(buf, offs)
            index = np.searchsorted(row, np.arange(stop - start + 1))
            lists = pa.ListArray.from_arrays(pa.array(index, pa.int32()), pa.array(term, pa.int32()))
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), lists], ["doc_id", "toxic", "terms"])


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fit on the labelled documents that aren't held out; the sample's bound is ``max_rows``."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_rows)
    labelled = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Of rows that repeat a doc_id one is taken, so the driver gets no more rows than the sample has.
    once = labelled.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.toxic", "r.text")
    found = arrow_map(once, _term_batches, "doc_id long, toxic int, terms array<int>").toArrow()
    found = found.take(pa.array(np.argsort(found["doc_id"].to_numpy(), kind="stable"))).combine_chunks()
    terms = found["terms"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(found.num_rows), np.diff(terms.offsets.to_numpy()) if found.num_rows else np.zeros(0, np.int64))
    return fit(row, terms.flatten().to_numpy().astype(np.int64), found["toxic"].to_numpy().astype(np.float64))


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; the machine's size is fixed by BITS and FACTORS."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(*term_sets(buf, offs), len(offs) - 1) for _, _, buf, offs in tk.chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "held_out", "score"])

    out = arrow_map(documents.select("doc_id", (fold() == 0).alias("held_out"), "text"), scores, "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, train(documents, read(spark, sf_dir, "labels")))
