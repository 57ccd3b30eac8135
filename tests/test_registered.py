"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        assert sorted(expected.columns) == columns
        place = [expected.columns.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
