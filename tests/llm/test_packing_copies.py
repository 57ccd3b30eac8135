"""Packing of rows that repeat each other, whole and in part."""

from collections import Counter, defaultdict

from quillgraph.llm import packing

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_long_rows_have_bins_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(1, long, "en", "x", 0)] * 2 + [(1, long[:40], "en", "x", 0), (None, long, "en", None, 0), (None, long, "en", None, 0), (2, long, "en", "y", 0)]
    df = spark.createDataFrame(rows, PLAIN)
    packed = packing.pack_documents(df, 10)
    held = defaultdict(list)
    for r in packed.collect():
        held[r.shard, r.bin].append(r)
    assert all(len({r.bin_offset for r in x}) == len(x) and sum(r.n_words for r in x) <= 10 for x in held.values())
    assert sum(shard == -1 for shard, _ in held) == 11
    out = packing.sequences(df, packed).collect()
    assert all(len(r.text.split()) <= 10 for r in out)
    assert Counter(w for r in out for w in r.text.split()) == Counter(w for r in rows for w in r[1].split())


def test_near_copies_share_no_sequence(spark):
    words = [f"w{i}" for i in range(120)]
    near = [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in range(5, 75, 10)]
    rows = [(i, t, "en", f"s{i}", 0) for i, t in enumerate(near)] + [(50 + i, " ".join(f"x{i}y{k}" for k in range(80)), "en", f"s{50 + i}", 0) for i in range(7)]
    held = defaultdict(list)
    for r in packing.pack_documents(spark.createDataFrame(rows, PLAIN), 400).collect():
        held[r.shard, r.bin].append(r.doc_id)
    assert all(sum(d < 50 for d in x) <= 1 for x in held.values())
    assert any(len(x) > 1 for x in held.values())


def test_very_many_equal_rows_are_spread_over_shards(spark):
    rows = [(1, "one two three", "en", "x", 0)] * 900 + [(i, f"w{i} a b", "en", f"s{i % 5}", 0) for i in range(10, 400)]
    packed = packing.pack_documents(spark.createDataFrame(rows, PLAIN), 50, pieces_each=100).collect()
    assert len(packed) == len(rows)
    by_shard = Counter(r.shard for r in packed if r.doc_id == 1)
    assert len(by_shard) == 13 and max(by_shard.values()) < 150
    held = defaultdict(list)
    for r in packed:
        held[r.shard, r.bin].append(r)
    assert all(sum(r.n_words for r in x) <= 50 and sum(r.doc_id == 1 for r in x) <= 1 for x in held.values())
