"""Ledgers, artifacts, task workspaces."""

import pytest

from quillgraph.tasks import TaskStore, TaskWorkspace


def test_ledger(spark, tmp_path):
    store = TaskStore(spark, str(tmp_path / "t"))
    task = store.open("mend it", ["be quick"])
    store.update(task, decisions=["use a join"], files=["a.py", "a.py"], next=["test"])
    store.update(task, decisions=["use a join"], constraints=["be quick", "be kind"], next=["ship"])
    store.close(task)
    state = store.state(task).first()
    assert (state.objective, state.state, state.constraints, state.decisions, state.files, state.next) == ("mend it", "closed", ["be quick", "be kind"], ["use a join"] * 2, ["a.py"], ["ship"])
    assert store.state(task, compact=True).first().decision_count == 2
    assert store.state("none").count() == 0


def test_artifacts(spark, tmp_path):
    store = TaskStore(spark, str(tmp_path / "a"))
    name = store.store_artifact("test_log", "ok\n  FAIL one\nError: two\nok")
    row = store.artifact(name).first()
    assert row.summary == "Test log: 4 lines. Failures: FAIL one | Error: two" and row.size_bytes == 27
    part = store.excerpt(name, 2, 9).first()
    assert (part.excerpt, part.start_line, part.end_line, part.total_lines) == ("  FAIL one\nError: two\nok", 2, 4, 4)


def test_workspace(tmp_path):
    (tmp_path / "r" / "d").mkdir(parents=True)
    (tmp_path / "r" / "d" / "f.py").write_text("a\nb\n")
    task = TaskWorkspace(str(tmp_path / "r"), str(tmp_path / "w"), ["d/f.py", "new.py"])
    assert task.apply() == [] and task.patch() == ""
    (tmp_path / "w" / "d" / "f.py").write_text("a\nc\n")
    (tmp_path / "w" / "new.py").write_text("x\n")
    assert task.status() == {"files": 2, "added": 2, "removed": 1}
    assert task.apply(dry_run=False) == ["d/f.py", "new.py"] and (tmp_path / "r" / "new.py").read_text() == "x\n"
    with pytest.raises(ValueError):
        TaskWorkspace(str(tmp_path / "r"), str(tmp_path / "w"), ["../out.py"])
