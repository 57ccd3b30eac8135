"""A small tree, end to end."""

import subprocess

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import workspace
from quillgraph.api import KnowledgeBase
from quillgraph.functions.scalar import normalize_path, route_score
from quillgraph.operators import analytics, build, community, context, linkage, resolve, traverse
from quillgraph.sources import files as source_files
from quillgraph.sources import changes, git, stores
from quillgraph.streaming import query_log

TREE = {
    "app/main.py": 'from app.store import Store\nimport os\n\ndef run(n: int):\n    """Runs all."""\n    s = Store()\n    s.save(n)\n    helper(n)\n    producer.produce("orders", n)\n\ndef helper(n):\n    requests.get("http://other/items/7")\n    missing_one()\n',
    "app/store.py": 'class Store(Base):\n    """Keeps rows."""\n    def save(self, n):\n        cursor.execute("x")\n        KafkaConsumer("orders")\n\n@app.get("/items/{id}")\ndef items(id):\n    return Store().save(id)\n',
    "web/index.ts": 'import { a as b, c } from "./lib";\nfunction page(x: string): string {\n  return c(x);\n}\n',
    "web/lib.ts": "export function c(x: string): string {\n  return x;\n}\n",
    "flows.yml": "daily:\n  tasks:\n    one: {operator: x.PythonOperator, python_callable_name: helper}\n    two: {operator: y, dependencies: [one]}\n",
    "node_modules/skip.js": "function no() {}\n",
    "notes.txt": "nothing",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def kb(spark, tree):
    base = KnowledgeBase(spark)
    base.sync(str(tree), "shop")
    return base


def rows(df, *columns):
    return {tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()}


def test_scan(kb):
    assert rows(kb.tables["files"], "path") == {"app/main.py", "app/store.py", "web/index.ts", "web/lib.ts", "flows.yml"}
    assert kb.jobs[0]["status"] == "done" and kb.job_status(kb.jobs[0]["job"])[0]["files"] == 5


def test_graph(kb):
    calls = rows(kb.calls, "src", "dst", "confidence")
    assert ("shop::app/main.py::run", "shop::app/main.py::helper", 0.95) in calls
    assert ("shop::app/main.py::helper", "missing_one", 0.7) in calls
    assert rows(kb.tables["resources"], "type", "dst") == {("PRODUCES_TO", "orders"), ("CONSUMES_FROM", "orders"), ("HTTP_CALL", "http://other/items/7"), ("CONNECTS_TO", "postgres"), ("EXPOSES", "/items/{id}")}
    owner = {r.dst: r.src for r in kb.tables["resources"].where("type <> 'CONSUMES_FROM'").collect()}
    assert owner["orders"] == "shop::app/main.py::run" and owner["postgres"] == "shop::app/store.py::save"
    assert rows(kb.tables["methods"], "class", "name") == {("Store", "save")}
    assert rows(kb.tables["heritage"], "name", "base", "type", "confidence") == {("Store", "Base", "EXTENDS", 0.7)}


def test_imports_and_types(kb):
    found = {(r.file, r.module): (r.resolved, r.external, r.confidence, list(r.names)) for r in kb.tables["imports"].collect()}
    assert found["web/index.ts", "./lib"] == ("web/lib.ts", False, 0.9, ["a", "c"])
    assert found["app/main.py", "os"] == (None, True, 0.6, ["*"])
    assert rows(kb.tables["typed_calls"], "caller", "callee", "type", "reason") == {("run", "s.save", "Store", "constructor_inference")}
    stats = resolve.import_stats(kb.tables["imports"]).first()
    assert (stats.total, stats.resolved, stats.external) == (3, 1, 2)


def test_python_relative_imports(spark):
    files = spark.createDataFrame([("s", "a/b/c.py", "python", "from ..x.y import z\nfrom . import q\nfrom .m import n as o"), ("s", "a/x/y.py", "python", ""), ("s", "a/b/m.py", "python", ""), ("s", "a/b/__init__.py", "python", "")], "service string, path string, language string, content string")
    found = {r.module: r.resolved for r in resolve.resolve_imports(resolve.imports(files), files).collect()}
    assert found == {"..x.y": "a/x/y.py", ".": "a/b/__init__.py", ".m": "a/b/m.py"}


def test_links(kb):
    links = kb.links()
    assert rows(links["kafka"], "src", "dst", "hub") == {("shop::app/main.py::run", "shop::app/store.py::save", "orders")}
    assert links["http"].count() == 0  # one service only


def test_questions(kb):
    assert rows(kb.impact("run", 2), "target") >= {"shop::app/main.py::helper", "missing_one"}
    assert ["shop::app/main.py::run", "shop::app/main.py::helper", "missing_one"] in [r.steps for r in kb.flows("run").collect()]
    context = kb.symbol_context("helper")
    assert rows(context["callers"], "name") == {"run"}
    assert kb.augment("save").first().callers == []
    assert kb.hotspots(3).count() <= 3
    assert "shop::app/main.py::run" in rows(kb.processes(), "process")
    assert kb.resource("services").first().functions == 6
    assert kb.scan_risks().where("id LIKE 'security::unprotected%'").count() == 1
    assert kb.parse_code("a.py", "def f(): pass")["symbols"][0]["name"] == "f"


def test_search_and_log(kb):
    for mode in ("keyword", "semantic", "hybrid"):
        found = kb.search("helper", 3, mode)
        assert found.count() <= 3
        assert "Function:app/main.py:helper" in rows(found, "id")
    event = kb.log_query("helper", kb.search("helper", 3), "hybrid").first()
    assert event.query == "helper" and event.top_score > 0


HIDDEN = [
    "WITH x AS (SELECT 7 a) INSERT INTO t SELECT a FROM x", "FROM functions INSERT INTO t SELECT name INSERT INTO u SELECT name", "EXECUTE IMMEDIATE 'DROP TABLE t'",
    "SELECT java_method('java.lang.System', 'getProperty', 'x')", "SELECT name FROM functions WHERE name IN (SELECT reflect('java.lang.System', 'getProperty', 'x'))", "SELECT (SELECT try_reflect('a', 'b'))",
    "BEGIN SELECT 1; DROP VIEW functions; END", "SELECT * FROM parquet.`/tmp`", "SELECT TRANSFORM(name) USING 'sh' FROM functions", "MERGE INTO t USING functions ON true WHEN MATCHED THEN DELETE", "CACHE TABLE functions", "SHOW TABLES",
]


def test_read_only_statements(kb):
    assert kb.query_graph("SELECT count(*) AS n, 'set offset' AS t FROM functions").first().n == 6
    for text in ("DROP VIEW functions", "CREATE TABLE x AS SELECT 1", "INSERT INTO functions SELECT 1", "SET a = 1", *HIDDEN):
        with pytest.raises(ValueError):
            kb.query_graph(text)
    assert kb.query_graph("WITH f AS (SELECT name FROM functions) SELECT count(*) AS n FROM f WHERE name IN (SELECT name FROM functions)").first().n == 6
    assert kb.query_graph("SELECT name FROM functions WHERE name = :name", {"name": "run"}).count() == 1


def test_snapshots(kb):
    snap = kb.snapshot("c1").first()
    assert snap.node_counts["Function"] == 6 and snap.kafka_topics == ["orders"] and snap.api_routes[0].path == "/items/{id}"


def test_context_pack(kb):
    pack = kb.context_pack("save", "w", max_files=2)
    assert pack["manifest"] and pack["estimated_tokens"] <= 12_000 and pack["sections"][-1]["id"] == "repo_capsule"
    source = pack["manifest"][0]["source"]
    assert kb.code_snippet(pack, source, 1, 3).count() >= 1
    with pytest.raises(PermissionError):
        kb.code_snippet(pack, "elsewhere.py")
    assert "Manifest" in workspace.render_pack(pack)


def test_incremental_index(spark, tree, tmp_path):
    files = source_files.scan(spark, str(tree), "shop")
    store = changes.ChangeLog(spark, str(tmp_path / "index"), source_files.SERVICE_INDEX_SCHEMA, ["service", "path"])
    assert store.load().count() == 0 and not store.exists()
    store.apply(files.select("service", "path", "content_hash", F.lit(None).cast("string").alias("last_commit"), F.current_timestamp().alias("indexed_at")))
    assert source_files.mark_changed(files, store.load()).where("changed").count() == 0
    assert source_files.mark_changed(files, store.load(), force=True).where("changed").count() == 5
    store.apply(spark.createDataFrame([("shop", "gone.py", "x", None, None)], source_files.SERVICE_INDEX_SCHEMA), files.select("service", "path"))
    assert source_files.mark_changed(files, store.load()).where("changed").count() == 5
    assert rows(source_files.deleted(files, store.load()), "path") == {"gone.py"}
    memory = changes.MemoryChanges(spark, source_files.SERVICE_INDEX_SCHEMA, ["service", "path"])
    memory.apply(store.load())
    assert memory.get("path", "gone.py").count() == 1


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-qm", "one")
    first = git.head(str(tmp_path))
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    run("add", "."), run("commit", "-qm", "two")
    assert rows(git.changed_files(spark, str(tmp_path)), "path", "status") == {("a.py", "modified"), ("b.py", "added")}
    assert git.commits_between(str(tmp_path), first) == 1 and git.head("/nowhere") is None
    found = workspace.detect(str(tmp_path))
    assert workspace.Manifest.from_yaml(workspace.Manifest("w", [found]).to_yaml()).repositories == [found]


def test_patches(tmp_path):
    for side, text in (("o", "a\nb\n"), ("c", "a\nc\n")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "f").write_text(text)
    diff = workspace.patch(str(tmp_path / "o"), str(tmp_path / "c"), ["f"])
    assert "-b" in diff and "+c" in diff and workspace.patch_lines(diff) == (1, 1)


def test_louvain_finds_two_cliques():
    links = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 1.0)]
    label = community.louvain(links)
    assert {label[i] for i in range(5)} != {label[i] for i in range(10, 15)} and len(set(label.values())) == 2
    assert community.modularity(links, label) > 0.4


def test_traces_stop_and_do_not_repeat():
    graph = {"a": ["b", "c", "d", "e"], "b": ["a", "f"], "c": ["f"], "f": ["g"]}
    found = traverse.trace_paths(graph, "a")
    assert found[0] == ["a", "b", "f", "g"] and all("e" not in t for t in found)
    assert traverse.trace_paths({}, "x") == []


def test_trails_do_not_repeat_an_edge(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    found = {tuple(r.nodes) for r in traverse.paths(edges, spark.createDataFrame([(1,)], "id long"), 5).collect()}
    assert found == {(1, 2), (1, 2, 1), (1, 2, 3)}


def http_all_pairs(callers: DataFrame, routes: DataFrame) -> DataFrame:
    """Links by the scoring function on every pair."""
    c = callers.select("caller", "service", "url").distinct()
    r = routes.select("handler", F.col("service").alias("route_service"), "route", "method").distinct()
    scored = c.join(r, c.service != r.route_service).withColumn("score", route_score(normalize_path(F.col("url")), normalize_path(F.col("route")))).where("score > 0")
    return scored.join(scored.groupBy("caller", "url").agg(F.max("score").alias("score")), ["caller", "url", "score"])


def test_http_link_agrees_with_all_pairs(spark):
    callers = spark.createDataFrame([(1, "a", "http://x/Items/7?q=1"), (2, "a", "/items/"), (3, "a", "/itemsX/9"), (4, "b", "/v1/users/3/posts"), (5, "a", "/"), (6, "a", "/x.y/1")], "caller long, service string, url string")
    routes = spark.createDataFrame([(1, "b", "/items/{id}", "GET"), (2, "b", "/items", "GET"), (3, "a", "/items/7", "GET"), (4, "c", "/v1/:kind/{n}/posts", "GET"), (5, "b", "/", "GET"), (6, "b", "/x.y/:n", "GET"), (7, "c", "/{any}/7", "GET")], "handler long, service string, route string, method string")
    pick = lambda df: rows(df, "caller", "handler", "score")
    assert pick(linkage.http(callers, routes)) == pick(http_all_pairs(callers, routes)) != set()


def test_ledger_folds_in_order(spark):
    schema = "task string, seq int, objective string, state string, constraints array<string>, decisions array<string>, files array<string>, commands array<string>, questions array<string>, next array<string>"
    updates = spark.createDataFrame([("t", 2, None, "work", ["b", "a"], ["d"], None, ["c"], None, ["n2"]), ("t", 1, "goal", "start", ["a"], ["d"], ["f"], None, None, ["n1"])], schema)
    state = context.ledger(updates).first()
    assert (state.objective, state.state, state.constraints, state.decisions, state.files, state.next) == ("goal", "work", ["a", "b"], ["d", "d"], ["f"], ["n2"])
    assert context.compact_ledger(context.ledger(updates)).first().decision_count == 2


def test_sections_skip_the_unreadable_and_stop_at_the_first_that_does_not_fit(spark):
    sections = spark.createDataFrame([([("a", 3), ("b", None), ("c", 4), ("d", 9), ("e", 1)],)], "s array<struct<id:string,tokens:bigint>>")
    out = sections.select(context.section_fold(F.col("s"), 10).alias("f")).first().f
    assert (out.ids, out.used) == (["a", "c"], 7)


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "src long, dst long, confidence double")
    functions = spark.createDataFrame([], "id long, name string, file string, service string, start_line int, end_line int")
    assert analytics.hotspots(functions, edges).count() == 0
    assert traverse.impact(edges, functions.select("id")).count() == 0
    assert traverse.entry_points(functions, edges).count() == 0
    assert analytics.risk_summary(spark.createDataFrame([], "severity string")).first().overall == "NONE"
    assert analytics.drift_summary(spark.createDataFrame([], "change string")).first().summary == "No contract drift"


def test_candidates_and_review(spark):
    owned = spark.createDataFrame([("s", "f", 1, "o", "docker_service", "t", "d", None), ("s", "f", 2, "o", "db_mongo", "t", "d", None)], "service string, file string, line int, owner string, kind string, target string, detail string, metadata map<string,string>")
    queue = build.candidates(owned)
    assert rows(queue, "id") == {"s::f::docker_service"}
    assert build.review(queue, "s::f::docker_service", "rejected", reason="no").first().status == "rejected"


def test_stream_windows_and_hits(spark, tmp_path):
    source = str(tmp_path / "events")
    events = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 5).alias("user_id"), F.concat(F.lit("q"), (F.col("id") % 2).cast("string")).alias("query"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("top_id"), (F.col("id") % 10 / 10).alias("top_score"))
    events.coalesce(1).write.parquet(source)
    stream = query_log.read_events(spark, source)
    query_log.write_windows(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    batch = query_log.windowed(events).collect()
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert closed and {(r.start, r.query, r.frequency) for r in closed} <= {(r.start, r.query, r.frequency) for r in batch}
    query_log.maintain_hits(stream, str(tmp_path / "hits"), str(tmp_path / "c2")).awaitTermination(60)
    assert {r.id: r.hit_count for r in query_log.read_hits(spark, str(tmp_path / "hits")).collect()} == {"c0": 67, "c1": 67, "c2": 66}
