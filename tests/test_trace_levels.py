"""Traces level by level against the walk over the whole graph, and what of a large graph a level's task is given."""

import random

import pyarrow as pa
import pytest

from quillgraph.operators import traverse


@pytest.mark.parametrize("seed", range(4))
def test_levels_against_the_plain_walk(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(130)})
    adjacency = {}
    for a, b in pairs:
        if a != b:
            adjacency.setdefault(a, []).append(b)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {}
    for r in traverse.traces(edges, spark.createDataFrame([(i,) for i in range(12)], "id long"), 3, 4, 6).collect():
        got.setdefault(r.entry, []).append((r.trace, r.steps))
    for entry in range(12):
        expected = traverse.trace_paths({k: v[:4] for k, v in adjacency.items()}, entry, 3, 6)
        assert [s for _, s in sorted(got.get(entry, []))] == expected


def test_a_task_holds_a_level(spark, monkeypatch, tmp_path):
    """Ten callees a node, but three are followed: at most 3 ** 4 trails of a level, of a graph of 5000 nodes."""
    sizes = str(tmp_path / "sizes")
    plain = traverse._walk

    def noting(*args):
        inner = plain(*args)

        def walk(table: pa.Table) -> pa.Table:
            with open(sizes, "a") as f:
                f.write(f"{table.num_rows}\n")
            return inner(table)

        return walk

    monkeypatch.setattr(traverse, "_walk", noting)
    edges = spark.range(5000).selectExpr("id AS src", "explode(sequence(1, 10)) AS k").selectExpr("src", "(src * 10 + k) % 5000 AS dst")
    assert traverse.traces(edges, spark.createDataFrame([(0,)], "id long"), depth=5).count() == 4
    assert max(map(int, open(sizes))) <= 3**4
