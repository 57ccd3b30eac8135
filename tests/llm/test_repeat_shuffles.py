"""Operator 5 shuffles the texts that it cuts, and no others."""

import time
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import repeats
from quillgraph.llm.frames import bitmap, marked

SCHEMA = "doc_id long, text string"


def written(spark) -> int:
    """Shuffle bytes that the local executor has written."""
    time.sleep(0.5)
    spark.range(1).count()
    time.sleep(0.5)
    return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def text(rng, n: int) -> str:
    return rng.integers(33, 127, n).astype(np.uint8).tobytes().decode()


def test_texts_without_repeats_stay_where_they_are(spark):
    rng = np.random.default_rng(3)
    passage = text(rng, 600)
    rows = [(i, text(rng, 20_000)) for i in range(200)] + [(1000 + i, text(rng, 300) + passage) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    before = written(spark)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, with_kept=False).collect()}
    assert written(spark) - before < 0.5 * sum(len(t) for _, t in rows)
    assert len(got) == len(rows)
    assert all(got[i].n_removed == 0 and got[i].n_bytes == 20_000 for i in range(200))
    assert all((got[1000 + i].n_removed, got[1000 + i].n_spans) == (600, 1) for i in range(4))


def test_hot_segments_bytes_are_not_multiplied(spark, monkeypatch):
    """Variants of a passage that all differ near its anchor: bytes are shuffled a round, not a block of starts."""
    monkeypatch.setattr(repeats, "HOT", 1)
    rng = np.random.default_rng(4)
    passage = text(rng, 900)
    rows = [(i, text(rng, 500) + passage[i : 900 - i] + text(rng, 500)) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    before = written(spark)
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs, with_kept=False).collect()}
    assert written(spark) - before < 8 * sum(len(t) for _, t in rows)
    count = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    expected = {}
    for k, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        expected[k] = int(gone.sum())
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 50_000])
def test_a_bitmap_loses_no_key(spark, n):
    keys = spark.range(n).toDF("k")
    got = marked(spark.range(200_000).toDF("k"), bitmap(keys), "k").where("marked")
    assert got.where(f"k < {n}").count() == n
    assert got.count() <= n + n // 50
