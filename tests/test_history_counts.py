"""Count deltas from sums of spans agree with those of facts; the pairs are broadcast, whatever their plan says of their size."""

from quillgraph.sources import changes


def test_counts_of_spans(spark):
    rows = [("s" if i % 3 else "t", "edge", f"l{i % 4}", str(i % 11), "d", i % 5, None if i % 2 else i % 5 + 1 + i % 3) for i in range(60)]
    history = spark.createDataFrame(sorted(set(rows), key=str), changes.HISTORY)
    history = history.dropDuplicates(changes.FACT)
    pairs = spark.createDataFrame([(s, a, b) for s in "st" for a in range(6) for b in range(6)], "service string, before long, after long")
    columns = ["service", "before", "after", "kind", "label", "delta"]
    pick = lambda df: {tuple(r) for r in df.select(*columns).collect()}
    found = changes.differences(history, pairs)
    assert pick(changes.history_count_differences(history, pairs)) == pick(changes.count_differences(found)) != set()
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
