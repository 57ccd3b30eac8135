"""Operator 7, SimHash near-dedup by a self-join of binary tries.

Fingerprints are 64 bits over 4-word shingles.  The distinct fingerprints are
keys of binary tries; two nodes of equal depth are traversed together, the
bits in which their paths differ are added up, and a pair of nodes is pruned
once the sum is above the budget at its depth.  With at most four differing
bits, one of five blocks of a fingerprint is free of them, so there is one
trie for each block, over the fingerprints rotated so that this block leads:
its budget is 0 down to the end of the block and 4 below.  Each subtree below
a lead block is a task of its own, and any pair within the budget meets in at
least one.  Equal fingerprints are one key, and pairs of nodes whose leaves
are already in one component are pruned, so groups of copies don't make pairs.

Defined cases: a null or empty text has the fingerprint zero and is linked
like any other; fewer than four words make one shingle of all of them;
repeated rows have equal fingerprints; a null doc_id never is the smallest,
a component of nulls only has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, components, cut, partitions_for, read, roots, whole_partition

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Blocks of a fingerprint from the highest bit, one more than the budget.
BLOCKS = (13, 13, 13, 13, 12)
BLOCK_PAIRS = 1 << 18
LEAF_PAIRS = 32
ROWS_EACH = 2_000_000


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> list[int]:
    """XXH64 of each space-joined shingle of lower-cased words; of all words if there are fewer."""
    digest = xxhash.xxh64_intdigest
    text = b" ".join(words)
    if len(words) <= size:
        return [digest(text, SEED)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1])
    return [digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    hashes = np.array(shingle_hashes(text.lower().split()), ">u8")
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        ones = np.unpackbits(octets, axis=1).sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints)], ["doc_id", "text_hash", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, hash of the text and fingerprint (as a signed long) of each document."""
    return arrow_map(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), _fingerprints, "doc_id long, text_hash long, fp long")


def _pairs_within(trie: np.ndarray, keys: np.ndarray, budget: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs within the budget, from the subtrees below the lead blocks; keys ascend within each trie.

    A node at some depth is the range [lo, hi) of its leaves, so a pair of
    nodes is five numbers.  Blocks of pairs are worked off from a stack, which
    bounds what is held however many pairs there are.
    """
    least = min(BLOCKS)
    lead = np.array(BLOCKS)[trie]
    top = keys >> np.uint64(64 - least)
    new = np.flatnonzero(np.r_[True, (trie[1:] != trie[:-1]) | (top[1:] != top[:-1])])
    end = np.r_[new[1:], len(keys)]
    several = end - new > 1
    change = np.cumsum(np.r_[0, label[1:] != label[:-1]])
    ones: dict[int, np.ndarray] = {}
    stack = [(least, new[several], end[several], new[several], end[several], np.zeros(several.sum(), np.int8))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > BLOCK_PAIRS:
            half = len(al) // 2
            stack += [(depth, *(x[:half] for x in (al, ah, bl, bh, err))), (depth, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        joined = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl])
        small = ~joined & (((ah - al) * (bh - bl) <= LEAF_PAIRS) | (depth == 64))
        if small.any():
            sal, sbl, nb = al[small], bl[small], (bh - bl)[small]
            each = (ah - al)[small] * nb
            which = np.repeat(np.arange(len(sal)), each)
            k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            a, b = sal[which] + k // nb[which], sbl[which] + k % nb[which]
            near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            if near.any():
                yield a[near], b[near]
        go = ~joined & ~small
        if not go.any():
            continue
        al, ah, bl, bh, err = (x[go] for x in (al, ah, bl, bh, err))
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        count = ones[depth]
        am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
        same = (al == bl) & (ah == bh)
        most = np.where(depth + 1 > lead[al], budget, 0)
        parts = []
        for x, y, z, w, step, of in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~same)):
            ok = (y > x) & (w > z) & (err + step <= most)
            if of is not None:
                ok &= of
            parts.append((x[ok], y[ok], z[ok], w[ok], (err + step)[ok].astype(np.int8)))
        merged = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if len(merged[0]):
            stack.append((depth + 1, *merged))


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = whole_partition(batches)
    if table is None:
        return
    trie = table["trie"].to_numpy().astype(np.int64)
    keys = table["turned"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((keys, trie))
    trie, keys = trie[order], keys[order]
    shift = np.array([sum(BLOCKS[:i]) for i in range(len(BLOCKS))], np.uint64)[trie]
    prints = ((keys >> shift) | (keys << ((np.uint64(64) - shift) & np.uint64(63)))).view(np.int64)
    label = np.arange(len(keys))
    for budget in range(1, BUDGET + 1):
        found_a, found_b = [], []
        for a, b in _pairs_within(trie, keys, budget, label):
            open_ = label[a] != label[b]
            links = np.unique(np.stack([label[a[open_]], label[b[open_]]]), axis=1)
            found_a.append(links[0])
            found_b.append(links[1])
        if found_a:
            label = roots(np.concatenate(found_a), np.concatenate(found_b), len(keys))[label]
    linked = np.flatnonzero(label != np.arange(len(keys)))
    yield pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[label[linked]])], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (column fp) joined by steps of at most four bits.

    Each task leaves a forest: no more links than it has keys, whatever the
    number of pairs within the budget.
    """
    prints = cut(prints.select("fp").distinct())
    turned, shift = [], 0
    for i, width in enumerate(BLOCKS):
        key = F.col("fp") if not shift else F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift))
        turned.append(F.struct(F.lit(i).alias("trie"), key.alias("turned"), F.shiftrightunsigned(key, 64 - width).alias("lead")))
        shift += width
    keys = prints.select(F.explode(F.array(*turned)).alias("k")).select("k.*")
    parts = partitions_for(prints.sparkSession, prints.count() * len(BLOCKS), ROWS_EACH)
    return arrow_map(keys.repartition(parts, "trie", "lead").select("trie", "turned"), _join_tries, "a long, b long")


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint of the group) and component_id (smallest doc_id reachable) of each document."""
    prints = cut(fingerprints(documents))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(prints)).withColumnRenamed("node", "fp")
    linked = nodes.join(root, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root").select("fp", "root", "component")
    # Cut, so that the join below reads both sides from exchanges and a fingerprint of very many documents is split.
    per_print = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")))
    return prints.join(per_print, "fp")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group (columns of documents): that with the smallest doc_id, and of repeated rows one."""
    first = groups(documents).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("f"))
    chosen = first.select(F.struct("f.doc_id", "f.text_hash").alias("row"))
    keyed = documents.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    return keyed.join(chosen, "row", "left_semi").dropDuplicates(["row"]).select("doc_id", "text", "lang", "source", "n_chars")


def hex16(value: str) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents")).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
