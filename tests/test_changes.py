"""Tables of changes: replay, merges, writers that meet or die, histories."""

import random

import pytest

from quillgraph.sources import changes

SCHEMA = "service string, path string, n long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(log):
    return {(r.service, r.path): r.n for r in log.load().collect()}


@pytest.mark.parametrize("kind", ["kept", "memory"])
def test_random_changes_against_a_dict(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(changes, "FAN", 3)
    log = changes.ChangeLog(spark, str(tmp_path / "t"), SCHEMA, ["service", "path"]) if kind == "kept" else changes.MemoryChanges(spark, SCHEMA, ["service", "path"])
    assert state(log) == {}
    rng, expected = random.Random(1), {}
    for step in range(14):
        put = {(rng.choice("ab"), rng.choice("uvwxyz")): step * 10 + k for k in range(rng.randint(0, 3))}
        gone = {(rng.choice("ab"), rng.choice("uvwxyz")) for _ in range(rng.randint(0, 2))}
        expected = {k: n for k, n in (expected | put).items() if k not in gone}
        log.apply(rows(spark, *((*k, n) for k, n in put.items())), spark.createDataFrame([(*k, 0) for k in gone], SCHEMA).select("service", "path") if step % 3 else None)
        if not step % 3:
            log.apply(None, spark.createDataFrame([(*k, 0) for k in gone], SCHEMA))
        assert state(log) == expected, step
    if kind == "kept":
        assert len(log.entries()) < 9 and any(e.endswith("-2") for e in log.entries())


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (changes.ChangeLog(spark, str(tmp_path / "t"), SCHEMA, ["service", "path"]) for _ in range(2))
    one.apply(rows(spark, ("a", "x", 1)))
    two.apply(rows(spark, ("b", "y", 2)))
    held = two.load()
    one.apply(rows(spark, ("b", "y", 3), ("a", "z", 4)))
    assert {(r.service, r.path): r.n for r in held.collect()} == {("a", "x"): 1, ("b", "y"): 2}  # a reader keeps what it saw
    assert state(one) == state(two) == {("a", "x"): 1, ("b", "y"): 3, ("a", "z"): 4}


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    log = changes.ChangeLog(spark, str(tmp_path / "t"), SCHEMA, ["service", "path"])
    log.apply(rows(spark, ("a", "x", 1)))
    rows(spark, ("a", "x", 9)).selectExpr("*", "false AS _gone", "CAST(NULL AS STRING) AS _at").write.partitionBy("service").parquet(str(tmp_path / "t/batches/batch=lost"))
    assert state(log) == {("a", "x"): 1}


def test_a_merge_that_stops_halfway(spark, tmp_path, monkeypatch):
    """Merged batch and sources stand in the log together: rows are the same, marks included."""
    log = changes.ChangeLog(spark, str(tmp_path / "t"), SCHEMA, ["service", "path"])
    log.apply(rows(spark, ("a", "x", 1), ("a", "y", 2)))
    log.apply(rows(spark, ("a", "y", 3)), rows(spark, ("a", "x", 0)))
    monkeypatch.setattr(changes, "FAN", 2)

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return stop if name == "rename" else getattr(self.fs, name)

    real = changes.ChangeLog._fs
    with monkeypatch.context() as patch:
        patch.setattr(changes.ChangeLog, "_fs", lambda self: Broken(real(self)))
        with pytest.raises(Stop):
            log.merge()
    assert len(log.entries()) == 3 and state(log) == {("a", "y"): 3}
    log.merge()
    assert state(log) == {("a", "y"): 3}
    log.apply(rows(spark, ("a", "x", 7)))
    assert state(log) == {("a", "x"): 7, ("a", "y"): 3}


def test_a_service_s_rows_read_its_folders_only(spark, tmp_path):
    log = changes.ChangeLog(spark, str(tmp_path / "t"), SCHEMA, ["service", "path"])
    log.apply(rows(spark, ("a", "x", 1), ("b", "x", 2)))
    plan = log.get("service", "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(service" in plan and state(log)[("b", "x")] == 2


def test_histories_against_copies(spark):
    rng, copies = random.Random(2), []
    history = spark.createDataFrame([], changes.HISTORY)
    for k in range(5):
        copies.append({("s", "node", rng.choice("FG"), str(rng.randrange(12)), "") for _ in range(rng.choice([0, 8, 20]))})
        new = changes.advance(history, spark.createDataFrame(list(copies[-1]), ", ".join(f"{c} string" for c in changes.FACT)), k).collect()
        key = [*changes.FACT, "opened"]
        history = spark.createDataFrame([r for r in history.collect() if tuple(r[c] for c in key) not in {tuple(n[c] for c in key) for n in new}] + new, changes.HISTORY)
    pairs = [(a, b) for a in range(5) for b in range(5)]
    found = changes.differences(history, spark.createDataFrame([("s", *p) for p in pairs], "service string, before long, after long")).collect()
    for a, b in pairs:
        got = {(r.change, *(r[c] for c in changes.FACT)) for r in found if (r.before, r.after) == (a, b)}
        assert got == {("added", *x) for x in copies[b] - copies[a]} | {("removed", *x) for x in copies[a] - copies[b]}
