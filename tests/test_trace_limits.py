"""Registered traces take the operator's own limits."""

import __spark_entry__


def test_traces_of_every_entry_point_to_the_whole_depth(spark):
    queries = __spark_entry__.queries()
    entries = {r.id for r in queries["g04_entry_points"](spark, "/root/testdata/sf0.001").collect()}
    found = queries["g05_traces"](spark, "/root/testdata/sf0.001").collect()
    assert len(entries) > 10 and len({r.entry for r in found}) > 10 and {r.entry for r in found} <= entries
    assert max(len(r.steps) for r in found) > 4
    longest = {}
    for r in queries["g06_process_steps"](spark, "/root/testdata/sf0.001").collect():
        longest[r.process] = max(longest.get(r.process, 0), r.step + 1)
    assert max(longest.values()) > 4
