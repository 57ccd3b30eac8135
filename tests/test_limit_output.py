"""A cut text is closed as JSON only where the whole of it is one value then."""

from quillgraph.operators import context


def test_only_whole_values_are_closed(spark):
    heads = ['{"k": ', "4763047826333361 Of ", '{"a": 1} and ', '{"a": 1}, {"k": ', '{"a": 1}], ["b", {"k": ', '{"a": 1}} {"k": ']
    rows = spark.createDataFrame([(i, (h + " " * 400)[:400] + "x" * 400) for i, h in enumerate(heads)], "id long, content string")
    found = {r.id: r.content for r in context.limit_output(rows, 12_000, 3_000, 100).collect()}
    assert found[0].endswith('"__truncated__"}')
    assert all(found[i] == (h + " " * 400)[:400] + "… [TRUNCATED]" for i, h in enumerate(heads) if i)
