"""Trigrams of many texts: small batches, and the same grams in whatever pieces a batch is taken."""

import pyarrow as pa

from quillgraph.operators import indexes


def test_batches_are_small(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = [f"text {i} abcabc" if i % 9 else None for i in range(300)]
    got = indexes.grams.func(pa.array(texts)).to_pylist()
    assert got == [sorted({t[i : i + 3] for i in range(len(t) - 2)}) if t else [] for t in texts]
    assert indexes.grams.func(pa.array([], pa.string())).to_pylist() == []
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    assert indexes.postings(nodes, ["id"], ["t"]).where("gram = 'abc'").count() == sum(t is not None for t in texts)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
