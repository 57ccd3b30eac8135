"""A cell of the vector search: the nearest of each query, few rows where many vectors are equally far, several cells a list."""

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.operators import indexes


def test_cell_against_all_pairs():
    rng = np.random.default_rng(5)
    have, ask = rng.normal(size=(700, 8)), rng.normal(size=(300, 8))
    have[100:400] = have[100]
    ask[0] = have[100]
    ids = rng.permutation(700)
    most = np.full(300, np.inf)
    most[150:] = 4.0
    vectors = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    entries = pa.table({"id": ids, "embedding": vectors(have)})
    found = indexes._near_in_cell(5, 8, 1e-9)(entries, pa.table({"query": np.arange(300), "point": vectors(ask), "most": most})).to_pylist()
    rows = {}
    for r in found:
        rows.setdefault(r["query"], []).append((r["squared"], r["id"]))
    for q in range(300):
        exact = sorted(zip(((have - ask[q]) ** 2).sum(1).tolist(), ids.tolist(), strict=True))[:5]
        assert sorted(rows.get(q, []))[:5] == [x for x in exact if x[0] <= most[q]]
    assert len(rows[0]) == 5


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocks_of_queries_and_parts(spark, metric, monkeypatch):
    monkeypatch.setattr(indexes, "PART_ROWS", 30)
    monkeypatch.setattr(indexes, "QUERY_ROWS", 20)
    vectors = np.random.default_rng(6).normal(size=(150, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    index = indexes.index_vectors(rows, lists=3, metric=metric)
    got = indexes.search_vectors(index, rows.selectExpr("id AS query", "embedding AS point"), 4).collect()
    unit = vectors if metric == "l2" else vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in range(150):
        away = ((unit - unit[q]) ** 2).sum(1) / (1 if metric == "l2" else 2)
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(150), away.round(6)))[:4].tolist()
