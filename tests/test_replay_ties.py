"""Lines with one place in the order: the first of the file counts."""

import datetime

import __spark_entry__

SCHEMA = "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"


def test_the_first_of_tied_lines_counts(spark, tmp_path):
    day = datetime.datetime(2000, 1, 1)
    # Part k has an older line (9) and three that tie (0, 1, 2); of odd parts the first is a mark, of even ones the others are.
    rows = [(k, k % 7, 1, 1, 9.0, "N", day) for k in range(40)]
    rows += [(k, k % 7, 2, 1, float(n), "R" if (n == 0) == bool(k % 2) else "N", day) for n in range(3) for k in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()["s04_log_replay"](spark, str(tmp_path)).collect()
    assert sorted((r.path, r.quantity) for r in got) == [(k, 0.0) for k in range(0, 40, 2)]
