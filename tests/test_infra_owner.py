"""Owners of patterns where very many functions and patterns lie in one file."""

from quillgraph.operators import build


def test_one_row_a_line_and_range_is_joined(spark):
    n = 30_000
    infra = spark.range(n).selectExpr("'s' AS service", "'f' AS file", "id AS ordinal", "id % 40 AS line", "'db_mongo' AS kind", "CAST(id AS string) AS target", "'' AS detail", "CAST(null AS map<string, string>) AS metadata")
    functions = spark.range(n).selectExpr("'s' AS service", "'f' AS file", "concat('n', id) AS name", "5 + id % 30 AS start_line", "14 + id % 30 AS end_line")
    owned = build.owned_infra(infra, functions)
    # Of 9e8 pairs of a pattern and a function none is made; 40 lines meet 30 ranges.
    found = {r.line: (r.owner, r["count"]) for r in owned.groupBy("line", "owner").count().collect()}
    for line in range(40):
        starts = [s for s in range(5, 35) if s <= line <= s + 9]
        assert found[line] == (min(f"n{i}" for i in range(starts[0] - 5, n, 30)) if starts else None, n // 40)
