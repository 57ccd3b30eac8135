"""Indexes against scans; longest trails against all trails."""

import random

import numpy as np
import pytest
from quillgraph.operators import indexes, search, traverse


def scan(points, queries, top, metric):
    out = []
    for q, v in queries:
        if metric == "cosine" and not np.any(v):
            continue
        unit = lambda x: np.array(x) / np.sqrt((np.array(x) ** 2).sum())
        found = []
        for i, p in points:
            if p is None or metric == "cosine" and not np.any(p):
                continue
            gap = (np.array(p) - np.array(v)) if metric == "l2" else unit(p) - unit(v)
            found.append((round(float((gap * gap).sum()) / (1 if metric == "l2" else 2), 6), i))
        out += [(q, i, d, k) for k, (d, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_by_index(spark, metric, monkeypatch, tmp_path):
    monkeypatch.setattr(indexes, "PART_ROWS", 30)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6)) * 4
    rows = [(i, [float(x) for x in centres[i % 5] * (1 + i % 2) + rng.normal(size=6) * 0.4]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [(2000, [0.0] * 6), (2001, None)]
    queries = rows[:40] + [rows[-2], (77, [9.0] * 6)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = indexes.index_vectors(chunks, 8, metric)
    asked = spark.createDataFrame(queries, "query long, point array<double>")
    got = sorted(tuple(r) for r in indexes.search_vectors(index, asked, 7).collect())
    assert got == scan(rows, queries, 7, metric)
    index.write(str(tmp_path / "kept"))
    again = indexes.VectorIndex.read(spark, str(tmp_path / "kept"))
    assert sorted(tuple(r) for r in indexes.search_vectors(again, asked, 7).collect()) == got
    assert len([r for r in indexes.search_vectors(index, asked, 1000).where("query = 3").collect()]) == (381 if metric == "l2" else 380)


def test_few_lists_are_read(spark):
    """Vectors in clear groups: a query's answer needs the lists of its own group only."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 10 + rng.normal(size=8) * 0.1]) for i in range(400)]
    index = indexes.index_vectors(spark.createDataFrame(rows, "id long, embedding array<double>"), 8)
    away = indexes._distances(np.array([rows[0][1]]), index.centroids)[0]
    reach = sum(r.rows for r in index.lists.collect() if max(away[r.list] - r.high, r.low - away[r.list], 0) <= 1)
    assert reach == 50


def test_no_vectors(spark):
    assert indexes.index_vectors(spark.createDataFrame([(1, None)], "id long, embedding array<double>")) is None


def test_keywords_by_trigram(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB é漢") for _ in range(rng.randint(0, 12)))
    rows = [(rng.choice(["Function", "Class"]), word() or "n", word() or "f", rng.choice([None, word() + " " + word()]), f"s{i % 3}") for i in range(300)]
    nodes = spark.createDataFrame(rows, "label string, name string, file string, docstring string, service string").dropDuplicates(search.NODE)
    indexes.write_postings(indexes.postings(nodes, search.NODE, search.TEXTS), str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p"))
    for pattern in ("aba", "ABB", "a", "", "é漢", "b é", "zzz", "abab", rows[5][1], "漢漢a"):
        plain, fast = (sorted(map(repr, (tuple(r) for r in search.keyword(nodes, pattern, 1000, p).collect()))) for p in (None, kept))
        assert plain == fast, pattern
    plan = indexes.containing(nodes, kept, "abab", search.NODE, search.TEXTS)._jdf.queryExecution().toString()
    assert "In(gram" in plan.replace("PushedFilters: [In(gram", "In(gram") and "PushedFilters: [" in plan


def all_trails(edges, starts, ends, depth):
    out, frontier = [], [[s] for s in starts]
    for _ in range(depth):
        frontier = [t + [b] for t in frontier for a, b in edges if a == t[-1] and (a, b) not in set(zip(t, t[1:]))]
        out += [t for t in frontier if t[-1] in ends and t[0] != t[-1]]
    return sorted(out, key=lambda t: (-len(t), t))


@pytest.mark.parametrize("seed, width", [(0, 256), (1, 2), (2, 1)])
def test_longest_trails_against_all(spark, seed, width, monkeypatch):
    monkeypatch.setattr(traverse, "WIDTH", width)
    monkeypatch.setattr(traverse, "WIDER", 2)
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(9), rng.randrange(11)) for _ in range(17)})
    frame = spark.createDataFrame([(*e, 0.9) for e in edges], "src long, dst long, confidence double")
    srcs, dsts = {a for a, _ in edges}, {b for _, b in edges}
    for start in (0,):
        one = spark.createDataFrame([(start,)], "id long")
        forward = [(tuple(r.steps), r.depth) for r in traverse.flows(frame, one, 4, 4).collect()]
        assert forward == [(tuple(t), len(t) - 1) for t in all_trails(edges, [start], dsts - srcs, 4)[:4]]
        backward = [(tuple(r.steps), r.depth) for r in traverse.flows(frame, one, 4, 4, backward=True).collect()]
        assert backward == [(tuple(t), len(t) - 1) for t in all_trails(edges, sorted(srcs - dsts), {start}, 4)[:4]]


def test_flows_without_an_end(spark):
    ring = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9)], "src long, dst long, confidence double")
    one = spark.createDataFrame([(1,)], "id long")
    assert traverse.flows(ring, one).collect() == [] and traverse.flows(ring.limit(0), one, backward=True).collect() == []
