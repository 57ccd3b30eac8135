"""The knowledge base as a session: index a source tree, then ask.

Tables are DataFrames; an answer is a DataFrame, or a dict of them where a
tool has several facets.  Nothing is written by asking: usage is an event that
``log_query`` returns for the caller to append.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import guard, workspace
from quillgraph.operators import analytics, build, community, context, indexes, linkage, resolve, search, symbols, traverse
from quillgraph.operators.lineage import cut
from quillgraph.parse import parser
from quillgraph.schemas import MECHANISMS, PARSED
from quillgraph.sources import files as source_files
from quillgraph.sources import changes, git, stores
from quillgraph.tasks import TaskStore

_EDGE = ["type", "src", "dst", "confidence"]
REVIEWS = "service string, candidate string, status string, approved_as string, reason string"
JOBS = "service string, job string, status string, started timestamp, ended timestamp, error string, files long, functions long, edges long, summary string"
COMMITS = "service string, sequence long, commit string, at timestamp"
#: Jobs that are listed.
KEPT_JOBS = 50


class KnowledgeBase:
    """Tables of indexed services and the questions that can be put to them."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """``folder``: where indexed files, their parsed records, reviews, jobs and histories are kept; without one they last as long as the session."""
        log = lambda name, schema, *key: changes.ChangeLog(spark, f"{folder}/{name}", schema, ["service", *key]) if folder else changes.MemoryChanges(spark, schema, ["service", *key])
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.running: list[dict] = []
        self._lock = threading.RLock()
        self._cached: list[DataFrame] = []
        self.vectors: indexes.VectorIndex | None = None
        self.postings: DataFrame | None = None
        self.index, self.sources, self.parsed = log("index", source_files.SERVICE_INDEX_SCHEMA, "path"), log("sources", source_files.SOURCE_SCHEMA, "path"), log("parsed", f"service string, {PARSED}", "file")
        self.reviews, self.finished = log("reviews", REVIEWS, "candidate"), log("jobs", JOBS, "job")
        self.commits, self.history = log("commits", COMMITS, "sequence"), log("history", changes.HISTORY, "kind", "label", "id", "detail", "opened")
        if folder and self.index.exists():
            self.load(self.sources.load(), self.parsed.load())

    # ---- indexing

    def sync(self, root: str, service: str, force: bool = False) -> dict:
        """Scan a tree, parse its new and changed files, drop those that are gone, and derive the tables of all services anew; returns the job.

        Kept tables get one batch of changed rows each, so what a sync writes
        follows the change.  Rows are replaced by (service, file), so the result
        is that of a full sync of every service.  The index is written last:
        after a failure the same files count as changed again.
        """
        return self._run(self._begin(service), root, service, force)

    def start_sync(self, root: str, service: str, force: bool = False) -> dict:
        """Begin a sync beside the caller and return its job at once; ``job_status`` tells how it goes."""
        job = self._begin(service)
        InheritableThread(target=self._quietly, args=(job, root, service, force), daemon=True).start()
        return dict(job)

    def _begin(self, service: str) -> dict:
        job = {"job": uuid.uuid4().hex[:8], "service": service, "status": "running", "started": datetime.now(UTC)}
        with self._lock:
            self.running.append(job)
        return job

    def _quietly(self, job: dict, *given) -> None:
        with contextlib.suppress(Exception):  # the job's record has the error
            self._run(job, *given)

    def _run(self, job: dict, root: str, service: str, force: bool) -> dict:
        try:
            job |= self._sync(root, service, force) | {"status": "done"}
        except Exception as error:
            job |= {"status": "error", "error": str(error)[:200]}
            raise
        finally:
            with self._lock:
                row = (service, job["job"], job["status"], job["started"], datetime.now(UTC), job.get("error"), job.get("files"), job.get("functions"), job.get("edges"), job.get("summary"))
                self.finished.apply(self.spark.createDataFrame([row], JOBS))
                self.running.remove(job)
        return job

    def _sync(self, root: str, service: str, force: bool) -> dict:
        commit = git.head(root)
        files, known = source_files.scan(self.spark, root, service), self.index.get("service", service)
        changed = cut(source_files.mark_changed(files, known, force).where("changed").drop("changed"))
        there = cut(files.select("path"))  # the reader leaves the contents out here
        gone = cut(known.join(there, "path", "left_anti").select("service", "path"))
        parsed = cut(parser.parse_files(changed))
        unparsed = changed.select("service", F.col("path").alias("file")).join(parsed, ["service", "file"], "left_anti")
        self.parsed.apply(parsed, gone.select("service", F.col("path").alias("file")).unionByName(unparsed))
        self.sources.apply(changed, gone)
        with self._lock:
            self.load(self.sources.load(), self.parsed.load())
            done = self._stats(service, there, changed, gone) | {"commit": commit}
            self._remember(service, commit)
        self.index.apply(changed.select("service", "path", "content_hash", F.lit(commit).alias("last_commit"), F.current_timestamp().alias("indexed_at")), gone)
        return done

    def _stats(self, service: str, files: DataFrame, changed: DataFrame, gone: DataFrame) -> dict:
        """Counts by phase, of one service, from one job, and a line that says them."""
        own = lambda name: self.tables[name].where(F.col("service") == service)
        calls = self.calls.join(own("functions").select(F.col("id").alias("src")), "src", "left_semi")
        counted = {"total": files, "changed": changed, "deleted": gone, "errors": own("parsed").where(F.size("errors") > 0), "calls": calls, "infra": own("owned"), "infra_edges": own("resources")}
        counted |= {name: own(name) for name in ("functions", "classes", "dags", "tasks", "chunks")} | {f"dag_{k}": e for k, e in build.dag_edges(own("tasks"), self.tables["functions"]).items()}
        rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("count").alias("of"), F.lit(name).alias("name"), "n") for name, df in counted.items()]
        for of, stats in (("imports", resolve.import_stats(own("imports"))), ("heritage", resolve.heritage_stats(own("heritage")))):
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in stats.columns)))
            rows.append(stats.select(F.lit(of).alias("of"), pairs.alias("p")).select("of", "p.*"))
        rows.append(own("files").where(F.col("language").isNotNull()).groupBy("language").agg(F.count(F.lit(1)).alias("n")).select(F.lit("language").alias("of"), F.col("language").alias("name"), "n"))
        found: dict[str, dict[str, int]] = {"imports": {}, "heritage": {}, "language": {}}
        for r in reduce(DataFrame.unionByName, rows).collect():
            found.setdefault(r.of, {})[r.name] = r.n
        n = found["count"]
        phases = {
            "filesystem": {"total": n["total"], "changed": n["changed"], "skipped": n["total"] - n["changed"], "deleted": n["deleted"]},
            "parse": {"parsed": n["changed"], "errors": n["errors"]},
            "graph": {"functions": n["functions"], "classes": n["classes"], "calls": n["calls"], "infra": n["infra"], "infra_edges": n["infra_edges"], "dag_nodes": n["dags"] + n["tasks"], "dag_edges": sum(v for k, v in n.items() if k.startswith("dag_"))},
            "vectors": {"chunks": n["chunks"]}, "imports": found["imports"], "heritage": found["heritage"],
        }
        languages, g = sorted(found["language"]), phases["graph"]
        said = f"Synced {g['functions']} functions, {g['classes']} classes, {g['calls']} call edges, {g['infra']} infra patterns ({g['infra_edges']} infra edges), {g['dag_nodes']} DAG/task nodes ({g['dag_edges']} DAG edges), {phases['vectors']['chunks']} vectors. Languages: {', '.join(languages) or 'none'}."
        return {"files": n["total"], "functions": g["functions"], "edges": g["calls"] + g["infra_edges"], "phases": phases, "summary": said}

    # ---- history

    def facts(self, service: str) -> DataFrame:
        """The service's nodes, edges and contracts as rows of (service, kind, label, id, detail)."""
        t = {name: self.tables[name].where(F.col("service") == service) for name in ("functions", "classes", "files", "resources")}
        fact = lambda df, kind, label, key, detail="": df.select("service", F.lit(kind).alias("kind"), (label if isinstance(label, F.Column) else F.lit(label)).alias("label"), key.alias("id"), (detail if isinstance(detail, F.Column) else F.lit(detail)).alias("detail"))
        named = F.concat_ws("::", "file", "name")
        calls = self.calls.join(t["functions"].select(F.col("id").alias("src"), "service"), "src")
        routes = t["resources"].where("label = 'APIRoute'")
        rows = [
            fact(t["functions"], "node", "Function", named), fact(t["classes"], "node", "Class", named), fact(t["files"], "node", "File", F.col("path")), fact(t["resources"], "node", F.col("label"), F.col("dst")),
            fact(calls, "edge", "CALLS", F.col("src"), F.col("dst")), fact(t["resources"], "edge", F.col("type"), F.col("src"), F.col("dst")), fact(routes, "route", "APIRoute", F.col("dst"), F.coalesce(F.col("metadata")["method"], F.lit("ALL"))),
        ]
        return reduce(DataFrame.unionByName, rows).fillna("").distinct()

    def _remember(self, service: str, commit: str | None) -> None:
        """Close and open the rows of the service's history that this sync changed."""
        last = self.commits.get("service", service).agg(F.max("sequence")).first()[0]
        sequence = 0 if last is None else last + 1
        self.history.apply(changes.advance(self.history.get("service", service), self.facts(service), sequence))
        self.commits.apply(self.spark.createDataFrame([(service, sequence, commit, datetime.now(UTC))], COMMITS))

    def changes_between(self, service: str, before: int, after: int) -> dict[str, DataFrame]:
        """What two syncs of a service (numbers of ``commits``) differ in: facts, counts, and drift of routes, topics and endpoints."""
        history = self.history.get("service", service)
        found = changes.differences(history, self.spark.createDataFrame([(service, before, after)], "service string, before long, after long"))
        routes = lambda at: changes.as_of(history.where("kind = 'route'"), F.lit(at)).select(F.col("id").alias("path"), F.col("detail").alias("method"))
        hubs = lambda at, label: changes.as_of(history.where((F.col("kind") == "node") & (F.col("label") == label)), F.lit(at)).select(F.col("id").alias("x"))
        drift = analytics.route_drift(routes(before), routes(after))
        out = {"facts": found.drop("before", "after"), "count_deltas": changes.count_differences(found).drop("before", "after"), "route_drift": drift, "drift_summary": analytics.drift_summary(drift)}
        return out | {name: analytics.set_drift(hubs(before, label), hubs(after, label), "x") for name, label in (("topic_drift", "KafkaTopic"), ("endpoint_drift", "GRPCEndpoint"))}

    def load(self, files: DataFrame, parsed: DataFrame | None = None) -> None:
        """Build all tables from (service, path, content, language, content_hash) and, if there, their parsed records."""
        for old in self._cached:
            old.unpersist()
        self._cached, self.vectors, self.postings = [], None, None

        def held(df: DataFrame) -> DataFrame:
            self._cached.append(df.cache())
            return df

        parsed = held(parser.parse_files(files) if parsed is None else parsed)
        syms, classes, infra = parser.symbols_of(parsed), parser.classes_of(parsed), parser.infra_of(parsed)
        node = F.concat_ws("::", "service", "file", "name")
        functions = held(build.function_nodes(syms).withColumn("id", node))
        sites = build.call_sites(syms)
        calls = build.call_edges(sites, functions)
        callee = F.when(F.col("callee_file").isNotNull(), F.concat_ws("::", "callee_service", "callee_file", "callee")).otherwise(F.col("callee"))
        call_rows = calls.select(F.lit("CALLS").alias("type"), F.concat_ws("::", "service", "file", "caller").alias("src"), callee.alias("dst"), "confidence", "sites")
        owned = held(build.owned_infra(infra, functions))
        linked = build.infra_edges(owned).select(F.col("edge").alias("type"), F.concat_ws("::", "service", "file", "owner").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("sites"), "label", F.col("service"), "metadata", "kind", F.col("type").alias("hub_type"))
        self.tables |= {
            "files": build.file_nodes(parsed), "services": build.service_nodes(parsed), "functions": functions, "classes": build.class_nodes(classes), "sites": sites,
            "edges": held(call_rows.select(*_EDGE, "sites").unionByName(linked.select(*_EDGE, "sites"))), "resources": linked, "candidates": build.candidates(owned), "owned": owned, "chunks": build.chunks(parsed),
            "heritage": resolve.heritage(classes), "imports": resolve.resolve_imports(resolve.imports(files), files), "bindings": resolve.bindings(files, classes, syms), "sources": files, "parsed": parsed,
            "inherits": build.inherits_edges(classes), "methods": build.method_edges(classes, functions), "typed_calls": resolve.resolve_calls(sites, resolve.bindings(files, classes, syms), classes), "dags": parser.dags_of(parsed), "tasks": parser.tasks_of(parsed),
        }
        self.tables["candidates"] = build.reviewed(self.tables["candidates"], self.reviews.load())
        for name in ("functions", "classes", "edges", "services", "files", "chunks"):
            self.tables[name].createOrReplaceTempView(name)

    @property
    def calls(self) -> DataFrame:
        return self.tables["edges"].where("type = 'CALLS'")

    def links(self, service: str | None = None) -> dict[str, DataFrame]:
        """Links over topics, brokers, RPC endpoints and HTTP routes."""
        r = self.tables["resources"]
        node = lambda kind: r.where(F.col("kind") == kind).select(F.col("src").alias("node"), F.col("dst").alias("hub"), "service")
        table = self.spark.createDataFrame(MECHANISMS, "mechanism string, publish string, consume string, label string")
        hubs = r.select("type", F.col("src").alias("node"), F.col("dst").alias("hub"), F.col("label").alias("hub_label"), "hub_type")
        routes = r.where("kind = 'http_route_define'").select(F.col("src").alias("handler"), "service", F.col("dst").alias("route"), F.col("metadata")["method"].alias("method"))
        callers = r.where("kind = 'http_request'").select(F.col("src").alias("caller"), "service", F.col("dst").alias("url"))
        return {"kafka": linkage.through_hub(node("kafka_produce"), node("kafka_consume"), "kafka"), "messaging": linkage.messaging(hubs, table), "grpc": linkage.rpc(node("grpc_call"), node("grpc_serve"), service), "http": linkage.http(callers, routes)}

    # ---- questions

    def query_graph(self, text: str, args: dict | None = None) -> DataFrame:
        """A read-only statement over the views; the whole parsed plan decides, not the words in it."""
        found = guard.refused(self.spark, text)
        if found:
            raise ValueError(f"read-only statements are allowed, not {found}")
        return self.spark.sql(text, args=args or {})

    def _searched(self) -> tuple[DataFrame, DataFrame]:
        """Nodes for keywords, and chunks with their vectors."""
        named = lambda name, label: self.tables[name].select(F.lit(label).alias("label"), "name", "file", "docstring", "service")
        files = self.tables["files"].select(F.lit("File").alias("label"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(None).cast("string").alias("docstring"), "service")
        label = F.when(F.col("id").contains("::class::"), "Class").otherwise("Function")
        chunks = self.tables["chunks"].where(F.col("name").isNotNull()).select(F.concat_ws(":", label, "file", "name").alias("id"), search.hash_embedding(F.col("document")).alias("embedding"))
        return named("functions", "Function").unionByName(named("classes", "Class")).unionByName(files), chunks

    def index_search(self) -> None:
        """Index the vectors of all chunks and the trigrams of all nodes; searches read these until the next sync."""
        nodes, chunks = self._searched()
        self.vectors, self.postings = indexes.index_vectors(chunks), cut(indexes.postings(nodes, search.NODE, search.TEXTS).sort("gram"))

    def search(self, text: str, top: int = 5, mode: str = "hybrid", events: DataFrame | None = None) -> DataFrame:
        nodes, chunks = self._searched()
        hits = stores.hit_counts(events) if events is not None else self.spark.createDataFrame([], "id string, hit_count long")
        point = self.spark.range(1).select(search.hash_embedding(F.lit(text)).alias("point"))
        return search.hybrid(nodes, text, chunks, point, hits, top, mode, self.vectors, self.postings)

    def log_query(self, text: str, results: DataFrame, mode: str) -> DataFrame:
        """The event of a search, to be appended to the log."""
        best = results.orderBy(F.desc("score")).limit(1)
        return best.select(F.lit(text).alias("query"), F.current_timestamp().alias("ts"), F.col("id").alias("top_id"), F.col("score").alias("top_score"), F.lit(mode).alias("mode"))

    def query_log(self, events: DataFrame, kind: str = "top_queries", limit: int = 10, days: int = 7) -> DataFrame:
        window = analytics.recent(events, F.current_timestamp(), days)
        reports = {"top_queries": lambda: analytics.top_queries(window, limit), "gap_queries": lambda: analytics.gap_queries(window, limit=limit), "hot_chunks": lambda: analytics.hot_chunks(window, limit), "recent": lambda: analytics.recent_queries(events, limit)}
        return reports[kind]()

    def impact(self, name: str, depth: int = 3, least: float = 0.0, direction: str = "out") -> DataFrame:
        starts = self.tables["functions"].where((F.col("name") == name) | (F.col("file") == name)).select("id")
        return traverse.impact(self.calls, starts, min(max(depth, 1), 10), least, direction)

    def impact_report(self, name: str, depth: int = 3, least: float = 0.0) -> dict[str, DataFrame]:
        """The impact of a function, and the three chunks nearest to its name."""
        return {"impact": self.impact(name, depth, least), "similar": self.search(name, 3, "semantic")}

    def flows(self, name: str, service: str | None = None, depth: int = 10, backward: bool = False) -> DataFrame:
        rows = self.tables["functions"].where(F.col("name") == name)
        rows = rows if service is None else rows.where(F.col("service") == service)
        return traverse.flows(self.calls, rows.select("id"), min(max(depth, 1), 15), backward=backward)

    def process_flows(self, name: str, service: str | None = None, depth: int = 10) -> dict[str, DataFrame]:
        """Flows from and to a function, and the processes it is a step of."""
        f = self.tables["functions"].where(F.col("name") == name)
        own = (f if service is None else f.where(F.col("service") == service)).select("id")
        return {"forward": self.flows(name, service, depth), "backward": self.flows(name, service, depth, backward=True), "processes": symbols.memberships(self.processes(), own)}

    def symbol_context(self, name: str, service: str | None = None) -> dict[str, DataFrame]:
        """The symbols of a name and what is one step away."""
        f, h = self.tables["functions"], self.tables["heritage"]
        found = symbols.lookup(f, name, service)
        starts = found.select("id")
        mine = h if service is None else h.where(F.col("service") == service)
        return {
            "symbols": found, "callers": symbols.neighbours(self.calls, f, found, "in"), "callees": symbols.neighbours(self.calls, f, found, "out"),
            "community": self.communities().join(starts.select(F.col("id").alias("node")), "node", "left_semi").orderBy("community", "node").limit(3),
            "processes": symbols.memberships(self.processes(), starts), "infra": self.tables["resources"].join(starts.select(F.col("id").alias("src")), "src", "left_semi").orderBy("type", "dst", "src").limit(10),
            "heritage": mine.where(F.col("name") == name), "children": mine.where((F.col("base") == name) & (F.col("type") == "EXTENDS")).orderBy("service", "file", "name").limit(10),
        }

    def symbol_text(self, name: str, service: str | None = None, most: int = 32_000) -> str:
        """The symbol's context as JSON lines, cut at ``most`` characters."""
        facets = self.symbol_context(name, service)
        text = "\n".join(f"{k}: [{', '.join(df.toJSON().collect())}]" for k, df in facets.items())
        return text if len(text) <= most else text[:most] + "… [TRUNCATED]"

    def augment(self, pattern: str, service: str | None = None, limit: int = 5) -> DataFrame:
        f = self.tables["functions"].withColumn("label", F.lit("Function"))
        matched = search.match_symbols(f, pattern, service, limit)
        names = matched.select(F.col("name").alias("target")).distinct()
        return symbols.augment(matched, {"callers": symbols.grouped_neighbours(self.calls, names, f, "in"), "callees": symbols.grouped_neighbours(self.calls, names, f, "out")})

    def candidates(self, service: str = "", limit: int = 50) -> DataFrame:
        return build.open_candidates(self.tables["candidates"], service, limit)

    def review(self, candidate: str, status: str, approved_as: str | None = None, reason: str | None = None) -> bool:
        """Promote or reject a candidate (status ``approved`` or ``rejected``); False if there is none of that id."""
        found = self.tables["candidates"].where(F.col("id") == candidate).select("service").first()
        if found is None:
            return False
        row = self.spark.createDataFrame([(found.service, candidate, status, approved_as, reason)], REVIEWS)
        self.reviews.apply(row)
        self.tables["candidates"] = build.reviewed(self.tables["candidates"], row)
        return True

    def communities(self) -> DataFrame:
        return community.communities(self.calls.join(self.tables["functions"].select(F.col("id").alias("src"), "service"), "src"))

    def processes(self, limit: int = 30) -> DataFrame:
        return traverse.processes(traverse.traces(self.calls, traverse.entry_points(self.tables["functions"], self.calls, limit)))

    def hotspots(self, top: int = 10) -> DataFrame:
        return analytics.hotspots(self.tables["functions"], self.calls, self.tables["resources"], top)

    def snapshot(self, commit: str) -> DataFrame:
        r = self.tables["resources"]
        nodes = analytics.node_counts(self.tables["functions"].select("service", F.lit("Function").alias("label")).unionByName(self.tables["classes"].select("service", F.lit("Class").alias("label"))).unionByName(self.tables["files"].select("service", F.lit("File").alias("label"))).unionByName(r.select("service", "label", "dst").distinct().select("service", "label")))
        edges = analytics.edge_counts(self.tables["edges"], self.tables["functions"])
        routes = r.where("label = 'APIRoute'").select("service", F.col("dst").alias("path"), F.coalesce(F.col("metadata")["method"], F.lit("ALL")).alias("method"))
        return analytics.snapshot(nodes, edges, routes, r.where("label = 'GRPCEndpoint'").select("service", F.col("dst").alias("endpoint")), r.where("label = 'KafkaTopic'").select("service", F.col("dst").alias("topic")), commit)

    def scan_risks(self, previous_routes: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
        f, r = self.tables["functions"], self.tables["resources"]
        exposes = r.where("label = 'APIRoute'").select(F.col("src").alias("handler"), F.col("dst").alias("path"), F.coalesce(F.col("metadata")["method"], F.lit("ALL")).alias("method"))
        before = previous_routes if previous_routes is not None else exposes.select("path", "method").limit(0)
        drift = before.join(exposes, ["path", "method"], "left_anti")
        return analytics.risk_items(self.hotspots(20), analytics.unprotected_routes(exposes, self.calls, f), analytics.fan_in_of(self.calls, r.where("label = 'Database'")), drift, analytics.repeated_calls(self.calls, f), threshold)

    def detect_changes(self, path: str, ref: str = "HEAD~1", before: DataFrame | None = None) -> dict[str, DataFrame]:
        """Impact of what changed since ``ref``, by risk; with a snapshot from before, also count deltas, contract drift and hotspots."""
        changed = git.changed_files(self.spark, path, ref)
        impact = analytics.change_impact(changed, self.tables["functions"], self.calls, self.tables["resources"])
        out = {"impact": impact.orderBy(F.desc("score"), "path"), "risks": analytics.risk_histogram(impact), "hotspots": self.hotspots(10)}
        if before is not None:
            now = self.snapshot("now")
            routes, topics, endpoints = (lambda s, c=c: s.select(F.explode(c).alias("x")) for c in ("api_routes", "kafka_topics", "grpc_endpoints"))
            counts = lambda s, c, key: s.select(F.explode(c).alias(key, "n")).groupBy(key).agg(F.sum("n").alias("n"))
            drift = analytics.route_drift(routes(before).select("x.*"), routes(now).select("x.*"))
            out |= {"node_deltas": analytics.count_deltas(counts(before, "node_counts", "label"), counts(now, "node_counts", "label"), "label"), "edge_deltas": analytics.count_deltas(counts(before, "edge_counts", "type"), counts(now, "edge_counts", "type"), "type"), "route_drift": drift, "drift_summary": analytics.drift_summary(drift)}
            out |= {"topic_drift": analytics.set_drift(topics(before), topics(now), "x"), "endpoint_drift": analytics.set_drift(endpoints(before), endpoints(now), "x")}
        return out

    def check_staleness(self, services: DataFrame, paths: dict[str, str]) -> DataFrame:
        """State of (service, last_commit) against the repositories' heads."""
        last = {r.service: r.last_commit for r in services.collect()}
        rows = [(s, git.head(p), git.commits_between(p, last[s]) if last.get(s) else None) for s, p in paths.items()]
        return git.staleness(services, self.spark.createDataFrame(rows, "service string, head string, behind int"))

    def parse_code(self, path: str, source: str) -> dict:
        return parser.parse_source(path, source)

    def resource(self, name: str, service: str | None = None) -> DataFrame:
        f, files = self.tables["functions"], self.tables["files"].withColumnRenamed("path", "file")
        views = {"services": lambda: symbols.service_counts(f, files), "overview": lambda: symbols.overview(f, self.calls, service), "languages": lambda: symbols.languages(files), "clusters": lambda: community.clusters(self.communities()), "flows": lambda: symbols.process_members(self.processes())}
        return views[name]()

    def context_pack(self, task: str, workspace_id: str, mode: str = "code", max_input: int = 12_000, reserved: int = 3_000, max_files: int = 8, ledger: DataFrame | None = None) -> dict:
        """Manifest and sections under a token budget, by search, snippets, ledger and repository overview."""
        found = self.search(task, max_files * 2).withColumnRenamed("source", "via")
        chunks = self.tables["chunks"].select(F.concat_ws(":", F.when(F.col("id").contains("::class::"), "Class").otherwise("Function"), "file", "name").alias("id"), "document", "service", "file", "name", "start_line", "end_line").dropDuplicates(["id"])
        ranked = search.ranked(found.join(chunks, "id"), [F.desc("score"), F.col("id")])
        kept = context.budget_prefix(ranked, max_input, max_files)
        manifest = [r.asDict() for r in context.manifest(kept, workspace_id).orderBy("rank").collect()]
        used = sum(m["tokens"] for m in manifest)
        sections = [{"id": f"snippet:{r.id}", "title": r.id, "content": r.document} for r in kept.orderBy("rank").collect()]
        if ledger is not None:
            text = ledger.select(context.ledger_text().alias("t")).first()
            if text is not None:
                sections.append({"id": "ledger", "title": "Task Ledger", "content": text.t})
        capsule = context.repo_capsule(self.tables["services"].select("name", F.array_join("languages", ",").alias("language"), F.lit(None).cast("string").alias("path")), workspace_id).first().capsule
        sections.append({"id": "repo_capsule", "title": "Repository Overview", "content": capsule})
        if not manifest:
            sections.insert(0, {"id": "kb_empty_warning", "title": "Knowledge base empty", "content": f"Nothing is indexed for {workspace_id}: run sync first."})
        return {"id": f"ctxpack_{uuid.uuid4().hex[:8]}", "task": task, "mode": mode, "budget": {"max_input": max_input, "reserved": reserved}, "estimated_tokens": used, "manifest": manifest, "sections": sections}

    def code_snippet(self, pack: dict, source: str, start: int = 1, end: int | None = None, max_tokens: int = 1500) -> DataFrame:
        """Lines of a source that the pack names, as far as the budget goes."""
        if not any(source in (m["source"], m["id"]) or m["id"].endswith(f"/{source}") for m in pack["manifest"]):
            raise PermissionError(f"{source} isn't in the pack's manifest")
        files = {m["source"] for m in pack["manifest"] if source in (m["source"], m["id"]) or m["id"].endswith(f"/{source}")}
        rows = context.lines(self.tables["sources"].where(F.col("path").isin(*files)).select(F.col("path").alias("file"), "content"))
        return context.snippet(rows, max_tokens, start, start + 49 if end is None else end)

    def workspace_status(self, path: str, debug: bool = False) -> dict:
        found = workspace.detect(path)
        return {"id": found.id, "head": found.head} | ({"path": found.path} if debug else {})

    def resolve_workspace(self, path: str, manifest: str | None = None, debug: bool = False) -> dict:
        """The repository that a path lies in and, with a manifest file's text, the workspace that names it."""
        found = workspace.detect(path)
        known = workspace.Manifest.from_yaml(manifest) if manifest else workspace.Manifest("default", [found])
        inside = any(r.id == found.id for r in known.repositories)
        out = {"workspace": known.id if inside else "default", "repository": found.id, "known": inside, "indexed": not self.index.load().where(F.col("service") == found.id).isEmpty()}
        return out | ({"path": found.path} if debug else {})

    def sync_current(self, path: str = ".", force: bool = False) -> dict:
        """Sync the repository that a path lies in, under its own id."""
        found = workspace.detect(path)
        return self.sync(found.path, found.id, force)

    @property
    def jobs(self) -> list[dict]:
        """The newest jobs, running ones included; what ended is kept with the tables, the last ``KEPT_JOBS`` count."""
        running = list(map(dict, self.running))  # before what is kept: a job is in one of the two at any time
        ended = [r.asDict() | {"started": r.started.astimezone(UTC)} for r in self.finished.load().orderBy(F.desc("started")).limit(KEPT_JOBS).collect()]
        known = {j["job"]: j for j in [*running, *ended]}
        return sorted(known.values(), key=lambda j: j["started"], reverse=True)[:KEPT_JOBS]

    def job_status(self, job: str | None = None) -> list[dict]:
        return [j for j in self.jobs if job is None or j["job"] == job][:10]

    def limit_output(self, text: DataFrame, max_input: int = 12_000, reserved: int = 3_000, max_output: int = 1_500, tasks: TaskStore | None = None) -> DataFrame:
        """Rows of (id, content): passed, trimmed, or offloaded to artifacts of ``tasks`` with their summary (without a store, cut and marked)."""
        if tasks is None:
            return context.limit_output(text, max_input, reserved, max_output)
        tasks.store_artifacts(context.offloaded(text, max_input, reserved, max_output))
        return context.limit_output(text, max_input, reserved, max_output, stored=True)
