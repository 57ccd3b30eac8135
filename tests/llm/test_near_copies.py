"""Near copies against all pairs of texts."""

from collections import Counter

import numpy as np

import corpus_pipeline
from quillgraph.llm import near_copies as n
from quillgraph.llm.frames import roots

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"edit{rng.integers(10**9)}"
    return " ".join(out)


def copies():
    """Originals of 150 words with copies of 0 to 8 changed words (similarity from 1 to under 0.6), a chain and odd texts."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        words = [f"w{rng.integers(3000)}" for _ in range(150)]
        texts += [edited(rng, words, e) for e in (0, 0, 1, 2, 2, 3, 3, 4, 5, 8)]
    words = [f"c{i}" for i in range(200)]
    texts += [" ".join(words[10 * i : 10 * i + 130]) for i in range(8)]
    texts += [None, "", " \n", "a b", "A b", "a c", *(f"one two three four {i}" for i in range(3))]
    return [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = copies()
    sets = [shingles(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    a, b = np.array(near).T
    expected = roots(a, b, len(rows)).tolist()
    df = spark.createDataFrame(rows, PLAIN)
    got = n.groups(df, "doc_id").collect()
    names = {}
    for r in got:
        names.setdefault(r.root, set()).add(r.doc_id)
    wanted = {}
    for i, r in enumerate(expected):
        wanted.setdefault(r, set()).add(i)
    assert sorted(map(sorted, names.values())) == sorted(map(sorted, wanted.values()))
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert Counter(r.doc_id for r in kept) == Counter(set(expected))


def test_signatures_estimate_the_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)] + [edited(rng, words, 9) for _ in range(200)]
    exact = np.array([similarity(shingles(texts[0]), shingles(t)) for t in texts[1:]])
    signs = n.signatures(n.shingle_sets(pa.array(texts)))
    equal = (signs[1:] == signs[0]).mean(1)
    assert abs(equal - exact - (1 - exact) / 256).mean() < 0.03 and abs((equal - exact).mean()) < 0.01
    assert (equal * signs.shape[1] >= n.LEAST_EQUAL).all() and (exact < 0.85).any()
    keys = n.bucket_keys(signs)
    assert ((keys[1:] == keys[0]).any(1)).all()


def test_copies_that_are_not_near_each_other(spark):
    """A hot bucket of texts that share a frame, but are no near copies, stays whole."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, words, 6), "en", "s", 0) for i in range(300)]
    sets = [shingles(r[1]) for r in rows]
    near = [(i, j) for i in range(300) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    a, b = np.array(near or [(0, 0)]).T
    got = n.groups(spark.createDataFrame(rows, PLAIN), "doc_id").select("root").distinct().count()
    assert got == len(set(roots(a, b, 300).tolist()))


def test_buckets_in_pairs_of_blocks(spark):
    """Blocks of a few texts join what one block joins."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(i, edited(rng, words, 3 + 2 * (i % 5)), "en", "s", 0) for i in range(120)], PLAIN)
    found = {}
    for size in (5, 1000):
        found[size] = Counter(frozenset(g.ids) for g in n.groups(df, "doc_id", block_rows=size).groupBy("root").agg({"doc_id": "collect_list"}).toDF("root", "ids").collect())
    assert found[5] == found[1000] and 1 < len(found[5]) < 120


def test_texts_by_shuffle_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(copies(), PLAIN)
    found = []
    for most in (n.BROADCAST_NODES, 0):
        monkeypatch.setattr(n, "BROADCAST_NODES", most)
        found.append(sorted((r.doc_id, r.root) for r in n.groups(df, "doc_id").collect()))
    assert [i for i, _ in found[0]] == [i for i, _ in found[1]]
    named = [{root: frozenset(i for i, x in f if x == root) for _, root in f} for f in found]
    assert set(named[0].values()) == set(named[1].values())


def test_empty_and_columns(spark, docs, none):
    assert n.groups(none, "doc_id").count() == 0
    assert n.keep_one(none).count() == 0
    assert n.keep_one(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
