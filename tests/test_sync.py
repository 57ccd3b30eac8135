"""Several services, incremental syncs, kept tables, hooks."""

import subprocess
import time

import pytest
from pyspark.sql import functions as F

from quillgraph import sync
from quillgraph.api import KnowledgeBase
from quillgraph.tasks import TaskStore

SHOP = {"app.py": "def sell(n):\n    requests.get('http://stock/items/7')\n    producer.produce('orders', n)\n\ndef old():\n    sell(1)\n", "more.py": "class Till(Base):\n    def ring(self):\n        sell(2)\n"}
STOCK = {"api.py": "@app.get('/items/{id}')\ndef items(id):\n    return find(id)\n\ndef find(id):\n    cursor.execute('x')\n\ndef listen():\n    KafkaConsumer('orders')\n"}


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def table(kb, name):
    df = kb.tables[name]
    plain = [c for c in df.columns if c not in ("detected_at",)]
    return sorted(map(repr, (tuple(r[c] for c in plain) for r in df.select(*plain).collect())))


NAMES = ("files", "functions", "classes", "edges", "resources", "chunks", "imports", "heritage", "methods")


def test_two_services_are_linked(spark, tmp_path):
    kb = KnowledgeBase(spark)
    kb.sync(write(tmp_path / "a", SHOP), "shop")
    job = kb.sync(write(tmp_path / "b", STOCK), "stock")
    assert {r.service for r in kb.tables["functions"].collect()} == {"shop", "stock"}
    links = kb.links()
    # A decorator stands before its function, so the file owns the route.
    assert {(r.caller, r.handler) for r in links["http"].collect()} == {("shop::app.py::sell", "stock::api.py")}
    assert {(r.src, r.dst) for r in links["kafka"].collect()} == {("shop::app.py::sell", "stock::api.py::listen")}
    assert job["phases"]["filesystem"] == {"total": 1, "changed": 1, "skipped": 0, "deleted": 0} and job["functions"] == 3
    assert job["summary"].startswith("Synced 3 functions, 0 classes, ") and job["phases"]["graph"]["calls"] > 0 and job["summary"].endswith("Languages: python.")


def test_incremental_equals_full(spark, tmp_path):
    kb = KnowledgeBase(spark)
    root, other = tmp_path / "a", write(tmp_path / "b", STOCK)
    kb.sync(write(root, SHOP | {"gone.py": "def lost():\n    sell(3)\n"}), "shop")
    kb.sync(other, "stock")
    (root / "gone.py").unlink()
    write(root, {"app.py": SHOP["app.py"].replace("old", "renamed"), "new.py": "def fresh():\n    renamed()\n"})
    job = kb.sync(str(root), "shop")
    assert job["phases"]["filesystem"] == {"total": 3, "changed": 2, "skipped": 1, "deleted": 1}
    again = kb.sync(str(root), "shop")
    assert again["phases"]["filesystem"] == {"total": 3, "changed": 0, "skipped": 3, "deleted": 0}
    full = KnowledgeBase(spark)
    full.sync(str(root), "shop")
    full.sync(other, "stock")
    for name in NAMES:
        assert table(kb, name) == table(full, name), name
    names = {r.name for r in kb.tables["functions"].collect()}
    assert {"renamed", "fresh"} <= names and not {"old", "lost"} & names
    forced = kb.sync(str(root), "shop", force=True)
    assert forced["phases"]["filesystem"]["changed"] == 3 and table(kb, "functions") == table(full, "functions")


def test_kept_between_sessions(spark, tmp_path):
    root, folder = write(tmp_path / "a", SHOP), str(tmp_path / "kept")
    first = KnowledgeBase(spark, folder)
    first.sync(root, "shop")
    second = KnowledgeBase(spark, folder)
    assert table(second, "functions") == table(first, "functions")
    assert second.sync(root, "shop")["phases"]["filesystem"]["skipped"] == 2


def test_a_failed_sync_leaves_the_index(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark)
    root = write(tmp_path / "a", SHOP)

    def broken(*_):
        raise RuntimeError("no")

    with monkeypatch.context() as patch:
        patch.setattr(KnowledgeBase, "load", broken)
        with pytest.raises(RuntimeError):
            kb.sync(root, "shop")
    assert kb.job_status()[0]["status"] == "error" and kb.index.load().isEmpty()
    assert kb.sync(root, "shop")["phases"]["filesystem"]["changed"] == 2


def test_start_sync_returns_at_once(spark, tmp_path):
    kb = KnowledgeBase(spark)
    root = write(tmp_path / "a", SHOP)
    job = kb.start_sync(root, "shop")
    assert job["status"] == "running" and kb.job_status(job["job"])[0]["job"] == job["job"]
    deadline = time.time() + 120
    while kb.job_status(job["job"])[0]["status"] == "running" and time.time() < deadline:
        time.sleep(0.5)
    assert kb.job_status(job["job"])[0]["status"] == "done" and kb.tables["functions"].count() == 3
    bad = kb.start_sync(str(tmp_path / "missing"), "none")
    while kb.job_status(bad["job"])[0]["status"] == "running" and time.time() < deadline:
        time.sleep(0.5)
    assert kb.job_status(bad["job"])[0]["status"] == "error"


def test_what_a_sync_writes_follows_the_change(spark, tmp_path):
    """One changed file of a small service writes as much beside a large service as alone."""

    def size(folder):
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    def written(name, others):
        root, folder = tmp_path / name, tmp_path / f"kept-{name}"
        kb = KnowledgeBase(spark, str(folder))
        if others:
            kb.sync(write(tmp_path / f"{name}-big", {f"m{i}.py": f"def f{i}():\n    g{i}({i})\n" * 300 for i in range(40)}), "big")
        kb.sync(write(root, SHOP), "shop")
        before = size(folder)
        write(root, {"app.py": SHOP["app.py"].replace("old", "renamed")})
        kb.sync(str(root), "shop")
        return size(folder) - before, before

    alone, _ = written("alone", False)
    beside, held = written("beside", True)
    assert held > 3 * beside and beside < 1.2 * alone


def test_history_compares_any_two_syncs(spark, tmp_path):
    root, kb = tmp_path / "a", KnowledgeBase(spark, str(tmp_path / "kept"))
    states = [SHOP, SHOP | {"new.py": "def fresh():\n    sell(1)\n"}, {"more.py": SHOP["more.py"]}, SHOP, SHOP]
    copies = []
    for files in states:
        for p in root.glob("*.py"):
            p.unlink()
        kb.sync(write(root, files), "shop")
        copies.append({tuple(r) for r in kb.facts("shop").collect()})
    assert [r.sequence for r in kb.commits.load().orderBy("sequence").collect()] == [0, 1, 2, 3, 4]
    again = KnowledgeBase(spark, str(tmp_path / "kept"))
    for a, b in ((0, 1), (0, 2), (2, 3), (0, 3), (3, 4), (4, 1)):
        found = again.changes_between("shop", a, b)
        got = {(r.change, r.service, r.kind, r.label, r.id, r.detail) for r in found["facts"].collect()}
        assert got == {("added", *x) for x in copies[b] - copies[a]} | {("removed", *x) for x in copies[a] - copies[b]}, (a, b)
        counts = {}
        for sign, copy in ((1, copies[b]), (-1, copies[a])):
            for x in copy:
                counts[x[1], x[2]] = counts.get((x[1], x[2]), 0) + sign
        assert {(r.kind, r.label): r.delta for r in found["count_deltas"].collect()} == {k: n for k, n in counts.items() if n}
    assert again.history.load().where("opened = 4 OR closed = 4").isEmpty()  # nothing changed, nothing written


def test_reviews_and_jobs_outlive_the_session(spark, tmp_path):
    folder = str(tmp_path / "kept")
    kb = KnowledgeBase(spark, folder)
    kb.sync(write(tmp_path / "a", {"jobs.py": "def beat():\n    app.task('x')\n"}), "shop")
    kb.tables["candidates"] = spark.createDataFrame([("shop::f::p", "shop", "f", 1, "p", "c", 0.5, "pending", None)], "id string, service string, file string, line int, pattern string, raw_code string, confidence double, status string, detected_at timestamp")
    assert kb.review("shop::f::p", "approved", "kafka_produce") and kb.review("shop::f::p", "rejected", reason="noise")
    again = KnowledgeBase(spark, folder)
    assert [tuple(r) for r in again.reviews.load().collect()] == [("shop", "shop::f::p", "rejected", None, "noise")]
    assert again.job_status()[0]["status"] == "done" and again.job_status()[0]["service"] == "shop"


def test_review_survives_a_sync(spark, tmp_path):
    kb = KnowledgeBase(spark)
    kb.sync(write(tmp_path / "a", SHOP), "shop")
    assert kb.review("none", "approved") is False
    kb.tables["candidates"] = spark.createDataFrame([("s::f::p", "s", "f", 1, "p", "c", 0.5, "pending", None)], "id string, service string, file string, line int, pattern string, raw_code string, confidence double, status string, detected_at timestamp")
    assert kb.candidates("s").count() == 1 and kb.review("s::f::p", "rejected", reason="noise")
    assert kb.candidates().first().status == "rejected"


def test_questions_of_the_session(spark, tmp_path):
    kb = KnowledgeBase(spark)
    kb.sync(write(tmp_path / "a", SHOP), "shop")
    kb.sync(write(tmp_path / "b", STOCK), "stock")
    facets = kb.symbol_context("sell", "shop")
    assert {"symbols", "callers", "callees", "community", "processes", "infra", "heritage", "children"} == set(facets)
    assert {r.name for r in facets["callers"].collect()} == {"old", "ring"} and facets["infra"].count() == 2
    assert kb.symbol_context("Till")["heritage"].first().base == "Base" and kb.symbol_context("Base")["children"].first().name == "Till"
    text = kb.symbol_text("sell")
    assert "symbols: [" in text and kb.symbol_text("sell", most=20) == text[:20] + "… [TRUNCATED]"
    flows = kb.process_flows("sell")
    assert {r.process for r in flows["processes"].collect()} >= {"shop::app.py::old"}
    report = kb.impact_report("old")
    assert report["impact"].count() >= 1 and report["similar"].count() <= 3


def test_changes_against_a_snapshot(spark, tmp_path):
    root = write(tmp_path / "r", STOCK)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "one")
    kb = KnowledgeBase(spark)
    kb.sync(root, "stock")
    before = spark.createDataFrame(kb.snapshot("one").collect(), kb.snapshot("one").schema)
    write(tmp_path / "r", {"api.py": STOCK["api.py"].replace("/items/{id}", "/things/{id}").replace("'orders'", "'sales'")})
    run("commit", "-qam", "two")
    kb.sync(root, "stock")
    found = kb.detect_changes(root, "HEAD~1", before)
    assert {r.name: r.change for r in found["route_drift"].collect()} == {"GET /items/{id}": "removed", "GET /things/{id}": "added"}
    assert {(r.name, r.change) for r in found["topic_drift"].collect()} == {("orders", "removed"), ("sales", "added")}
    assert found["drift_summary"].first().breaking == 1 and found["impact"].first().path == "api.py"
    assert found["node_deltas"].count() == 0 and found["hotspots"].count() > 0


def test_output_limits(spark, tmp_path):
    kb, tasks = KnowledgeBase(spark), TaskStore(spark, str(tmp_path / "tasks"))
    texts = [("short", "ab"), ("json", '{"' + "a" * 29 + '": 1,"k":' + '"' + "9" * 30 + '"}'), ("plain", "y" * 90), ("long", "z" * 5000)]
    df = spark.createDataFrame(texts, "id string, content string")
    got = {r.id: (r.action, r.content) for r in kb.limit_output(df, 100, 0, 10, tasks).collect()}
    assert got["short"] == ("pass", "ab")
    assert got["json"] == ("trim", texts[1][1][:40] + '"__truncated__"}')
    assert got["plain"] == ("trim", "y" * 40 + "… [TRUNCATED]")
    action, content = got["long"]
    artifact = content.split('"')[3]
    assert action == "offload" and tasks.excerpt(artifact).count() == 1
    kb.limit_output(df, 100, 0, 10, tasks)
    assert tasks._read("artifacts", "id string").count() == 1
    assert kb.limit_output(df, 100, 0, 10).where("id = 'long'").first().content == "z" * 40 + "… [OFFLOAD REQUIRED]"


def test_hooks(spark, tmp_path):
    root = write(tmp_path / "r", SHOP)
    subprocess.run(["git", "-C", root, "init", "-q"], check=True)
    hook = tmp_path / "r/.git/hooks/post-merge"
    hook.parent.mkdir(exist_ok=True)
    hook.write_text("#!/bin/sh\necho mine\n")
    for _ in range(2):
        files = sync.main([root, "--service", "shop", "--folder", str(tmp_path / "k"), "--install"]).splitlines()
    assert len(files) == 2 and hook.read_text().count("quillgraph.sync") == 1 and "echo mine" in hook.read_text()
    said = sync.main([root, "--service", "shop", "--folder", str(tmp_path / "k")])
    assert said.startswith("sync done | service=shop total=2 changed=2 skipped=0 deleted=0 | Synced 3 functions, 1 classes")
    assert "changed=0 skipped=2" in sync.main([root, "--service", "shop", "--folder", str(tmp_path / "k")])


def test_core_keyword_search(spark):
    from quillgraph.operators import search

    nodes = spark.createDataFrame([("Function", "save", "a.py", "Keeps it. " * 40, "s"), ("Class", "Other", "b.py", None, "s")], "label string, name string, file string, docstring string, service string")
    found = search.keyword_core(nodes, "SAVE", 5).first()
    assert (found.id, found.score, found.source) == ("s::a.py::save", 0.0, "keyword") and found.document == "[Function] save\nFile: a.py\nDoc: " + "Keeps it. " * 40
    assert search.keyword_core(nodes, "b.py", 5).select(F.col("document")).first().document == "[Class] Other\nFile: b.py"


def test_packs_are_kept(spark, tmp_path):
    kb, tasks = KnowledgeBase(spark), TaskStore(spark, str(tmp_path / "tasks"))
    kb.sync(write(tmp_path / "a", SHOP), "shop")
    pack = kb.context_pack("sell", "w", max_files=2)
    assert tasks.store_pack(pack) == pack["id"] and tasks.pack("none") is None
    again = tasks.pack(pack["id"])
    assert again["manifest"] == pack["manifest"] and kb.code_snippet(again, again["manifest"][0]["source"], 1, 2).count() >= 1


def test_workspaces_of_the_session(spark, tmp_path):
    root = write(tmp_path / "r", SHOP | {"package.json": '{"name": "@me/till"}'})
    subprocess.run(["git", "-C", root, "init", "-q"], check=True)
    kb = KnowledgeBase(spark)
    before = kb.resolve_workspace(root)
    assert before == {"workspace": "default", "repository": "till", "known": True, "indexed": False}
    assert kb.sync_current(root)["service"] == "till"
    after = kb.resolve_workspace(root, "id: w\nrepositories: [{id: till, path: x}]", debug=True)
    assert (after["workspace"], after["indexed"], after["path"]) == ("w", True, root)
    assert kb.resolve_workspace(root, "id: w\nrepositories: [{id: other, path: x}]")["known"] is False
