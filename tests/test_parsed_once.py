"""Queries that read parsed records several times parse the files once."""

import os

import pytest

from quillgraph.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["s21_call_edges", "s22_method_edges", "s23_infra_edges", "j12_type_resolution", "f11_chunks", "f18_type_bindings"])
def test_no_second_parse(spark, name):
    assert QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") <= (name in ("j12_type_resolution", "f18_type_bindings"))
