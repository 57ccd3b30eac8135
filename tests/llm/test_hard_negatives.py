"""Operator 11 against scoring every anchor with every row, and against its SQL."""

import random

import duckdb
import numpy as np
import pytest

from quillgraph.llm import hard_negatives as hn
from quillgraph.llm import sql

SCHEMA = "vec_id long, embedding array<float>, label int, norm string, tile int"


def brute(rows, every):
    kept = [(r[0], r[2], r[1]) for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    dims = max((len(k[2]) for k in kept), default=0)
    ids, labels = [k[0] for k in kept], [(k[1] + 1) % 10 if k[0] % 7 == 0 else k[1] for k in kept]
    whole = [[int(np.floor(256 * float(np.float32(x)))) for x in k[2]] + [0] * (dims - len(k[2])) for k in kept]
    out = []
    for a, anchor in enumerate(ids):
        if anchor % every:
            continue
        score = [sum(x * y for x, y in zip(whole[a], w)) for w in whole]
        ranked = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in ranked if labels[j] == labels[a]][:5]:
            negatives = [j for j in ranked if labels[j] != labels[a] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(anchor, ids[p], rank, ids[j], score[p], score[j]) for rank, j in enumerate(negatives, 1)]
    return sorted(out)


def made_up(n, dims, seed, copies=0, spread=1.0):
    """Vectors around a few centres, of different lengths, with copies, ties, nulls and odd components."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = (centres[rng.integers(6)] + 0.3 * rng.normal(size=dims)) * rng.uniform(0.2, 3) * spread
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 5)), None, 1))
    common = rows[3][1]
    rows += [(n + i, common, int(i % 2), None, None) for i in range(copies)]
    rows += [(10 * n + 20, None, 1, None, None), (10 * n + 40, [float("nan")] + common[1:], 1, None, None), (10 * n + 60, [float("inf")] + common[1:], 2, None, None), (10 * n + 80, [None] + common[1:], 2, None, None)]
    rows += [(None, common, 1, None, None), (10 * n + 100, common, None, None, None), (10 * n + 120, common[:-1], 3, None, None), (10 * n + 140, [0.0] * dims, 3, None, None), rows[20], rows[20], rows[40]]
    random.Random(seed).shuffle(rows)
    return rows


def mined(spark, rows, every, **options):
    return sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), every, **options).collect())


@pytest.mark.parametrize("n, dims, copies, options", [(300, 8, 150, {"pivots": 5, "cells": 16, "tile_rows": 20}), (400, 2, 0, {"pivots": 8, "cells": 64, "tile_rows": 10}), (120, 32, 40, {})])
def test_against_all_pairs(spark, n, dims, copies, options):
    rows = made_up(n, dims, n, copies)
    assert mined(spark, rows, 20, **options) == brute(rows, 20)


def test_long_components_and_small_bounds(spark, monkeypatch):
    """Scores beyond 2**53 use whole numbers; slices, blocks and split tiles change nothing."""
    monkeypatch.setattr(hn, "SLICE", 3)
    monkeypatch.setattr(hn, "SCORES", 64)
    rows = made_up(150, 4, 7, 30, spread=1e5)
    assert mined(spark, rows, 10, pivots=3, cells=4, tile_rows=8) == brute(rows, 10)


def test_pruning_reads_less_and_loses_nothing(spark, monkeypatch):
    """With vectors in few dimensions most tiles are never scanned."""
    rows = [(i, [float(np.cos(i / 40)), float(np.sin(i / 40))], i % 3, None, None) for i in range(240)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = hn.build(hn.prepare(frame), pivots=8, cells=128, tile_rows=8)
    least, greatest = hn._bounds(index, np.array([[256, 0]]))
    true = hn.distances(hn.augmented(np.array([[256, 0]]), 1 << 16), hn.augmented(np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64), 1 << 16))
    assert (least < 100).mean() < 0.5 and true.min() < 1
    assert mined(spark, rows, 20, pivots=8, cells=128, tile_rows=8) == brute(rows, 20)


def test_packing_round_trip():
    import pyarrow as pa

    vectors = [np.array([1, -2, 3]), np.array([1 << 20, 0, -5]), np.array([1 << 40, 7]), np.zeros(0, np.int64)]
    out = hn.unpacked(pa.array([hn.packed(v) for v in vectors], pa.binary()), 3)
    assert out.tolist() == [[1, -2, 3], [1 << 20, 0, -5], [1 << 40, 7, 0], [0, 0, 0]]


def test_sql_agrees(spark, tmp_path):
    rows = [r for r in made_up(350, 6, 2, 60) if r[1] is None or len(r[1]) == 6]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    got = sorted(tuple(r) for r in hn.mine(spark.read.parquet(str(tmp_path / "e"))).collect())
    assert got == sorted(con.execute(sql.op11()).fetchall()) == brute(rows, 100) and got


def test_empty_and_lone_rows(spark):
    assert hn.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.mine(spark.createDataFrame([(0, [1.0, 0.0], 1, None, None)], SCHEMA)).collect() == []
    assert hn.mine(spark.createDataFrame([(0, [], 1, None, None), (1, [], 1, None, None)], SCHEMA)).collect() == []
