import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from quillgraph.llm import simhash as s

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_ids(prints):
    """Smallest id reachable, by breadth-first search over all pairs."""
    ids = list(range(len(prints)))
    out = {}
    for i in ids:
        if i in out:
            continue
        group, queue = {i}, [i]
        while queue:
            a = queue.pop()
            for b in ids:
                if b not in group and (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                    group.add(b)
                    queue.append(b)
        for b in group:
            out[b] = min((prints[c][0] for c in group if prints[c][0] is not None), default=None)
    return [(prints[i][0], format(prints[i][1], "016x"), out[i]) for i in ids]


def test_against_all_pairs(spark, docs, rows):
    expected = component_ids([(r[0], fingerprint(r[1])) for r in rows])
    got = s.groups(docs).select("doc_id", s.hex16("fp").alias("f"), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def joined(prints):
    keys, trie = [], []
    shift = 0
    for i, width in enumerate(s.BLOCKS):
        keys.append(prints if not shift else (prints << np.uint64(shift)) | (prints >> np.uint64(64 - shift)))
        trie.append(np.full(len(prints), i))
        shift += width
    batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(trie)), pa.array(np.concatenate(keys).view(np.int64))], ["trie", "turned"])
    out = list(s._join_tries(iter([batch])))[0]
    a, b = (np.searchsorted(prints, out.column(k).to_numpy().view(np.uint64)) for k in (0, 1))
    return s.roots(a, b, len(prints)), out.num_rows


def test_trie_join_on_dense_clusters():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 3)).astype(np.uint64), axis=1)
    prints = np.unique(np.concatenate([centre[rng.integers(0, 3, 900)] ^ flips, rng.integers(0, 2**63, 600, dtype=np.uint64), np.array([0], np.uint64)]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    expected = s.roots(*np.nonzero(np.triu(near, 1)), len(prints))
    got, links = joined(prints)
    assert np.array_equal(got, expected)
    assert links <= len(prints) * len(s.BLOCKS)


def test_one_of_each_group_stays(spark, docs, rows):
    groups = {r.doc_id for r in s.groups(docs).select("component_id").distinct().withColumnRenamed("component_id", "doc_id").collect()}
    kept = s.keep_one(docs).collect()
    assert len(kept) == s.groups(docs).select("root").distinct().count()
    assert {r.doc_id for r in kept} == groups
    assert s.keep_one(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty(none):
    assert s.groups(none).count() == 0
    assert s.keep_one(none).count() == 0
