"""One registered query for each operator that the driver's tables can show, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalar as S
from quillgraph.operators import analytics as A
from quillgraph.operators import build, community, context, indexes, linkage, resolve, search, symbols, traverse
from quillgraph.operators.lineage import cut
from quillgraph.parse import parser
from quillgraph.plans.fixtures import Views
from quillgraph.plans.oracles import using
from quillgraph.schemas import MECHANISMS
from quillgraph.sources import files as source_files
from quillgraph.sources import changes, git, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views under a name, with its SQL."""

    def keep(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def ids(v: Views, *values: int) -> DataFrame:
    return v.spark.createDataFrame([(x,) for x in values], "id long")


# ---- sources and sinks

_LANGUAGE_SQL = "CASE WHEN ext IN ('go') THEN 'go' WHEN ext = 'py' THEN 'python' WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN ext IN ('yml', 'yaml') THEN 'yaml' WHEN ext = 'java' THEN 'java' END"
_FILES_SQL = "SELECT doc_id, source || '/' || ['src', 'node_modules', 'lib', 'build', 'pkg'][doc_id % 5 + 1] || '/f' || doc_id || ['.go', '.py', '.TS', '.txt', '.yml', '.jsx'][doc_id % 6 + 1] AS path, text AS content FROM documents"


def _files(v: Views) -> DataFrame:
    part = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat("source", F.lit("/"), part(("src", "node_modules", "lib", "build", "pkg"), 5), F.lit("/f"), F.col("doc_id").cast("string"), part((".go", ".py", ".TS", ".txt", ".yml", ".jsx"), 6))
    return v.table("documents").select("doc_id", path.alias("path"), F.col("text").alias("content"))


@query("s01_scan_files", f"WITH f AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM ({_FILES_SQL})) SELECT doc_id, path, {_LANGUAGE_SQL} AS language, substr(sha256(content), 1, 16) AS content_hash FROM f WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', 'build']) AND {_LANGUAGE_SQL} IS NOT NULL")
def _(v):
    return source_files.select_files(_files(v)).select("doc_id", "path", "language", "content_hash")


@query("s02_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


@query("s03_incremental_scan", "SELECT doc_id AS path, n_chars, lang IN ('fr', 'es') AS changed FROM documents")
def _(v):
    docs = v.table("documents").select(F.col("doc_id").alias("path"), "n_chars", "lang", S.content_hash(F.col("text")).alias("content_hash"))
    index = docs.where("lang <> 'fr'").select("path", F.when(F.col("lang") == "es", "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return source_files.mark_changed(docs, index).select("path", "n_chars", "changed")


_LINES = "SELECT l_suppkey AS service, l_partkey AS path, l_orderkey * 10 + l_linenumber AS seq, l_returnflag = 'R' AS gone, l_quantity AS quantity, l_shipdate AS shipped FROM lineitem"


@query("s04_log_replay", f"SELECT service, path, quantity, shipped FROM (SELECT * FROM ({_LINES}) QUALIFY row_number() OVER (PARTITION BY service, path ORDER BY seq DESC) = 1) WHERE NOT gone")
def _(v):
    # SQL leaves open which of several lines with one seq counts; here it is the first of the file.
    at = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (-F.col("_metadata.row_index")).alias("row"), "_metadata.file_name")
    lines = v.table("lineitem").select(F.col("l_suppkey").alias("service"), F.col("l_partkey").alias("path"), at.alias("at"), (F.col("l_returnflag") == "R").alias("gone"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("shipped"))
    return changes.newest(lines, ["service", "path"], "at", "gone")


# Five states of a graph: customers' links to priorities by the orders of a year and the next.
_STATES = "SELECT DISTINCT y - 1995 AS sequence, o_orderpriority AS label, o_custkey::VARCHAR AS id, o_orderstatus AS detail FROM orders, (VALUES (1995), (1996), (1997), (1998), (1999)) t(y) WHERE year(o_orderdate) IN (y, y + 1)"


def _history(v: Views) -> DataFrame:
    orders = v.table("orders").select(F.year("o_orderdate").alias("y"), F.lit("s").alias("service"), F.lit("edge").alias("kind"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("detail"))
    history = v.spark.createDataFrame(v.spark.sparkContext.emptyRDD(), changes.HISTORY)
    for k, year in enumerate(range(1995, 2000)):
        facts = orders.where(F.col("y").isin(year, year + 1)).select(*changes.FACT).distinct()
        new = changes.advance(history, facts, k)
        history = cut(history.join(new.select(*changes.FACT, "opened"), [*changes.FACT, "opened"], "left_anti").select(*new.columns).unionByName(new))
    return history


@query("s26_history_intervals", f"WITH s AS ({_STATES}), runs AS (SELECT *, sequence - row_number() OVER (PARTITION BY label, id, detail ORDER BY sequence) AS run FROM s) SELECT label, id, detail, min(sequence)::BIGINT AS opened, CASE WHEN max(sequence) < 4 THEN max(sequence) + 1 END::BIGINT AS closed FROM runs GROUP BY label, id, detail, run")
def _(v):
    return _history(v).select("label", "id", "detail", "opened", "closed")


@query("u02_history_deltas", f"WITH s AS ({_STATES}), n AS (SELECT sequence, label, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT a.sequence AS before, b.sequence AS after, l.label FROM range(5) a(sequence), range(5) b(sequence), (SELECT DISTINCT label FROM s) l) SELECT before::BIGINT AS before, after::BIGINT AS after, p.label, (coalesce(y.n, 0) - coalesce(x.n, 0))::BIGINT AS delta FROM p LEFT JOIN n x ON x.sequence = before AND x.label = p.label LEFT JOIN n y ON y.sequence = after AND y.label = p.label WHERE coalesce(y.n, 0) <> coalesce(x.n, 0)")
def _(v):
    pairs = v.spark.createDataFrame([("s", a, b) for a in range(5) for b in range(5)], "service string, before long, after long")
    return changes.history_count_differences(_history(v), pairs).select("before", "after", "label", F.col("delta").cast("long").alias("delta"))


@query("u03_history_drift", f"WITH s AS ({_STATES}) SELECT 'removed' AS change, label, id, detail FROM (SELECT label, id, detail FROM s WHERE sequence = 1 EXCEPT SELECT label, id, detail FROM s WHERE sequence = 3) UNION ALL SELECT 'added', label, id, detail FROM (SELECT label, id, detail FROM s WHERE sequence = 3 EXCEPT SELECT label, id, detail FROM s WHERE sequence = 1)")
def _(v):
    pair = v.spark.createDataFrame([("s", 1, 3)], "service string, before long, after long")
    return changes.differences(_history(v), pair).select("change", "label", "id", "detail")


@query("s03_deleted_files", "SELECT doc_id AS path FROM documents WHERE lang = 'de'")
def _(v):
    docs = v.table("documents").select(F.col("doc_id").alias("path"), "lang")
    return source_files.deleted(docs.where("lang <> 'de'"), docs)


@query("s06_languages", f"SELECT coalesce(language, '-') AS language, count(*) AS n FROM (SELECT {_LANGUAGE_SQL} AS language FROM (SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM ({_FILES_SQL}))) GROUP BY 1")
def _(v):
    return _files(v).groupBy(F.coalesce(S.language_of(F.col("path")), F.lit("-")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("s13_upsert", "SELECT o_custkey AS name, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS seq, min(o_orderdate) AS first_seen FROM orders GROUP BY o_custkey")
def _(v):
    rows = v.table("orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("first_seen"))
    return source_files.upsert(rows.where("status = 'F'"), rows.where("status <> 'F'"), ["name"], "seq", "first_seen")


_L2_SQL = "SELECT v.vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, id LIMIT 10"


def _near(v: Views, top: int = 10, metric: str = "l2") -> DataFrame:
    return search.vector(v.chunks(), v.chunks().where("id = 0").select(F.col("embedding").alias("point")), top, metric)


@query("s14_vector_topk", _L2_SQL)
def _(v):
    return _near(v).select("id", "distance")


@query("k01_vector_cosine", _L2_SQL.replace("round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6)", "round(1 - list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)"))
def _(v):
    return _near(v, 10, "cosine").select("id", "distance")


_ALL_NEAR = "SELECT query, id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, {distance} AS distance FROM embeddings q, embeddings v)) WHERE rank <= 10"


def _all_near(v: Views, metric: str) -> DataFrame:
    """Every chunk as a query, over an index of all."""
    index = indexes.index_vectors(v.chunks(), metric=metric)
    return indexes.search_vectors(index, v.chunks().select(F.col("id").alias("query"), F.col("embedding").alias("point")), 10)


@query("s14_vector_index", _ALL_NEAR.format(distance="round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6)"))
def _(v):
    return _all_near(v, "l2")


@query("k01_vector_index_cosine", _ALL_NEAR.format(distance="round(greatest(0, 1 - list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"))
def _(v):
    return _all_near(v, "cosine")


@query("s16_delete_chunks", "SELECT vec_id AS id, label FROM embeddings WHERE label <> 3")
def _(v):
    return stores.delete_by_ids(v.chunks(), v.chunks().where("label = 3").select("id")).select("id", "label")


@query("s16_get_chunks", "SELECT vec_id AS id, label FROM embeddings WHERE label = 3")
def _(v):
    return stores.get_by_ids(v.chunks(), v.chunks().where("label = 3").select("id")).select("id", "label")


@query("s17_hit_counts", using("ev", sql="SELECT top_id AS id, count(*) AS hit_count, max(ts) AS last_queried FROM ev GROUP BY top_id"))
def _(v):
    return stores.hit_counts(v.events())


@query("s17_chunks_with_hits", using("ev", sql="SELECT vec_id AS id, label, coalesce(n, 0) AS hit_count FROM embeddings LEFT JOIN (SELECT top_id, count(*) AS n FROM ev GROUP BY top_id) ON top_id = vec_id"))
def _(v):
    return stores.with_hits(v.chunks(), stores.hit_counts(v.events())).select("id", "label", "hit_count")


@query("s27_insert_absent", "WITH old AS (SELECT c_custkey AS id, 1 AS seen FROM customer WHERE c_mktsegment <> 'BUILDING'), new AS (SELECT c_custkey AS id, c_nationkey AS seen FROM customer WHERE c_acctbal > 0) SELECT coalesce(old.id, new.id) AS id, greatest(old.seen, new.seen) AS seen FROM old FULL JOIN new ON old.id = new.id")
def _(v):
    c = v.table("customer")
    return source_files.insert_absent(c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit(1).alias("seen")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("seen")), "id", "seen")


@query("s28_name_status", "SELECT 'src/f' || doc_id || '.py' AS path, CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status FROM documents")
def _(v):
    code = F.element_at(F.array(*map(F.lit, ("A", "D", "R087", "M"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return git.parse_name_status(v.table("documents").select(F.concat(code, F.lit("\tsrc/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("value")))


_SLUG = "left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)"


@query("s32_promoted_slugs", f"WITH s AS (SELECT doc_id, source, {_SLUG} AS slug FROM documents) SELECT doc_id, slug FROM s WHERE source <> 'src0' AND slug NOT IN (SELECT slug FROM s WHERE source = 'src0')")
def _(v):
    hot = v.table("documents").select("doc_id", "source", S.slug(F.col("text")).alias("slug"))
    return stores.promoted(hot.where("source <> 'src0'"), hot.where("source = 'src0'").select("slug")).select("doc_id", "slug")


# ---- filters and projections

_KW = "SELECT label || ':' || file || ':' || name AS id, label, concat_ws(chr(10), '[' || label || '] ' || name, 'File: ' || file, CASE WHEN docstring <> '' THEN 'Doc: ' || left(docstring, 200) END) AS document FROM kw WHERE contains(lower(name), 'license') OR contains(lower(file), 'license') OR contains(lower(docstring), 'license') ORDER BY id LIMIT 20"


@query("p01_keyword", using("kw", sql=_KW))
def _(v):
    return search.keyword(v.keyword_nodes(), "License", 20).select("id", "label", "document")


@query("p01_keyword_postings", using("kw", sql=_KW))
def _(v):
    nodes = v.keyword_nodes()
    return search.keyword(nodes, "License", 20, indexes.postings(nodes, search.NODE, search.TEXTS)).select("id", "label", "document")


@query("p04_match_symbols", using("kw", sql="SELECT name, file, service FROM kw WHERE contains(name, 'src1_1') AND service = 'src1' ORDER BY name, file, service LIMIT 10"))
def _(v):
    return search.match_symbols(v.keyword_nodes(), "src1_1", "src1", 10).select("name", "file", "service")


@query("p05_symbol_lookup", using("fn", sql="SELECT id, name, place::INT AS place, n > 1 AS ambiguous FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY service, file, id) AS place, count(*) OVER (PARTITION BY name) AS n FROM fn WHERE name = 'red widget') WHERE place <= 5"))
def _(v):
    return symbols.lookup(v.functions(), "red widget").select("id", "name", "place", "ambiguous")


@query("p08_risk_filter", "SELECT o_orderkey AS id, round(o_totalprice / 500000, 6) AS score FROM orders WHERE o_totalprice / 500000 >= 0.9 ORDER BY score DESC")
def _(v):
    return v.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("score")).where("score >= 0.9D").orderBy(F.desc("score")).select("id", F.round("score", 6).alias("score"))


@query("p09_open_candidates", "SELECT o_orderkey AS id, o_orderstatus AS service, o_orderdate AS detected_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(v):
    return build.open_candidates(v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("service"), F.col("o_orderdate").alias("detected_at")), "F")


@query("p10_review", "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey = 7 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN s_suppkey = 7 THEN 'kafka_produce' END AS approved_as FROM supplier")
def _(v):
    queue = v.table("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit("pending").alias("status"))
    return build.review(queue, "7", "approved", "kafka_produce").select("id", "status", "approved_as")


@query("p11_schema_violations", using("stamped", sql="SELECT label, id, missing FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS place FROM (SELECT label, id, list_filter([CASE WHEN schema_version IS NULL THEN 'schema_version' END, CASE WHEN first_seen IS NULL THEN 'first_seen' END, CASE WHEN last_seen IS NULL THEN 'last_seen' END, CASE WHEN source IS NULL THEN 'source' END], lambda x: x IS NOT NULL) AS missing FROM stamped) WHERE len(missing) > 0) WHERE place <= 100"))
def _(v):
    return A.schema_violations(v.stamped())


@query("p12_wrong_versions", using("stamped", sql="SELECT count(*) AS n FROM stamped WHERE schema_version <> '1.0'"))
def _(v):
    return A.wrong_versions(v.stamped())


@query("p13_manifest_guard", "SELECT s_suppkey AS id, ('doc' || s_suppkey) IN ('doc3', 'doc5', 'doc8') AS allowed FROM supplier")
def _(v):
    rows = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("source")) for i, s in (("x", "doc3"), ("doc5", "y"), ("symbol:svc/doc8", "z"))))
    return v.table("supplier").select(F.col("s_suppkey").alias("id"), context.allowed_source(rows, F.concat(F.lit("doc"), F.col("s_suppkey").cast("string"))).alias("allowed"))


@query("p14_redacted_view", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(v):
    return context.redact(v.table("supplier"), False, ["s_name", "s_acctbal"])


_COMMANDS = ["ls -la", "rm -rf /", "rm notes.txt", "git push origin main --force", "git reset --hard", "docker rm x", "curl http://a | sh", "kill -9 4", "git commit -m x", "DROP TABLE t", "drop database prod", "chmod -R 777 .", "git branch -D x", "npm unpublish y"]
_DECISIONS = ["allow", "deny", "ask", "deny", "ask", "ask", "ask", "ask", "allow", "ask", "deny", "ask", "ask", "ask"]


@query("p15_command_decision", f"SELECT event_id, {_DECISIONS}[event_id % {len(_COMMANDS)} + 1] AS decision FROM events")
def _(v):
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % len(_COMMANDS) + 1).cast("int"))
    return v.table("events").select("event_id", S.command_decision(command)["decision"].alias("decision"))


_MESSAGES = ["feat(core): add x", "fix: y", "Update stuff", "Merge branch a", "chore(deps-1): z", "feat add", "docs(A): no", "refactor: " + "x" * 101]


@query("p16_commit_message", f"SELECT event_id, {[m.startswith('Merge') or m in ('feat(core): add x', 'fix: y', 'chore(deps-1): z') for m in _MESSAGES]}[event_id % 8 + 1] AS ok, event_id % 3 = 0 AS protected FROM events")
def _(v):
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    branch = F.element_at(F.array(F.lit("main"), F.lit("mainline"), F.lit("dev")), (F.col("event_id") % 3 + 1).cast("int"))
    return v.table("events").select("event_id", S.is_conventional_commit(message).alias("ok"), S.is_protected_branch(branch).alias("protected"))


# ---- joins


def _neighbour_sql(near: str, far: str) -> str:
    return using("fn", "calls", sql=f"SELECT {far} AS id, name, max(confidence) AS confidence FROM calls JOIN fn ON fn.id = {far} WHERE {near} IN (SELECT id FROM fn WHERE name = 'red widget') GROUP BY 1, 2 ORDER BY confidence DESC, id LIMIT 15")


@query("j01_callers", _neighbour_sql("dst", "src"))
def _(v):
    f = v.functions()
    return symbols.neighbours(v.calls(), f, f.where("name = 'red widget'"), "in").select("id", "name", "confidence")


@query("j01_callees", _neighbour_sql("src", "dst"))
def _(v):
    f = v.functions()
    return symbols.neighbours(v.calls(), f, f.where("name = 'red widget'"), "out").select("id", "name", "confidence")


@query("j02_infra_of_symbol", using("fn", "res", sql="SELECT DISTINCT dst AS id FROM res JOIN fn ON fn.id = src WHERE name = 'red widget' AND type = 'CONNECTS_TO' ORDER BY id LIMIT 10"))
def _(v):
    return symbols.one_hop(v.resources(), "CONNECTS_TO", v.functions().where("name = 'red widget'"), 10)


_FACET = "SELECT t.name AS target, list_slice(list_sort(list(DISTINCT o.name)), 1, 3) AS names FROM calls JOIN fn t ON t.id = {near} JOIN fn o ON o.id = {far} WHERE t.name LIKE '%ring%' GROUP BY t.name"


@query("j04_augment", using("fn", "calls", sql=f"SELECT DISTINCT fn.name, coalesce(c.names, []) AS callers, coalesce(d.names, []) AS callees FROM fn LEFT JOIN ({_FACET.format(near='dst', far='src')}) c ON c.target = fn.name LEFT JOIN ({_FACET.format(near='src', far='dst')}) d ON d.target = fn.name WHERE fn.name LIKE '%ring%'"))
def _(v):
    f, c = v.functions(), v.calls()
    names = f.where("name LIKE '%ring%'").select(F.col("name").alias("target")).distinct()
    matched = names.select(F.col("target").alias("name"))
    return symbols.augment(matched, {"callers": symbols.grouped_neighbours(c, names, f, "in"), "callees": symbols.grouped_neighbours(c, names, f, "out")})


@query("j05_infra_owner", using("fn", sql="WITH i AS (SELECT p_partkey AS ordinal, p_brand AS service, p_type AS file, p_size + 5 AS line FROM part) SELECT i.service, i.file, i.line, i.ordinal, arg_min(fn.name, (fn.start_line, -fn.end_line, fn.name)) AS owner FROM i LEFT JOIN fn ON fn.service = i.service AND fn.file = i.file AND i.line BETWEEN fn.start_line AND fn.end_line GROUP BY ALL"))
def _(v):
    p = v.table("part")
    infra = p.select(F.col("p_brand").alias("service"), F.col("p_type").alias("file"), F.col("p_partkey").alias("ordinal"), (F.col("p_size") + 5).alias("line"), F.lit("db_mongo").alias("kind"), F.col("p_partkey").cast("string").alias("target"), F.lit("").alias("detail"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return build.owned_infra(infra, v.functions()).select("service", "file", "line", F.col("target").cast("long").alias("ordinal"), "owner")


_HUB = "SELECT p.node AS src, c.node AS dst, p.hub FROM prod p JOIN cons c ON p.hub = c.hub WHERE p.node <> c.node"


@query("j06_kafka_linkage", using("prod", "cons", sql=f"SELECT src, dst, hub, 'kafka' AS mechanism FROM ({_HUB})"))
def _(v):
    return linkage.through_hub(v.produced(), v.consumed(), "kafka")


@query("j06_linkage_pairs", using("prod", "cons", sql=f"SELECT src, dst, max(hub) AS via, count(*) AS hubs FROM ({_HUB}) GROUP BY src, dst"))
def _(v):
    return linkage.pair_view(v.produced(), v.consumed())


_MSG = "SELECT l_suppkey AS node, l_partkey AS hub, ['rabbitmq', 'redis', 'sqs', 'nats'][l_partkey % 4 + 1] AS mechanism, l_returnflag = 'A' AS publishes FROM lineitem WHERE l_returnflag <> 'R'"


@query("j07_messaging_linkage", f"WITH m AS (SELECT DISTINCT * FROM ({_MSG})) SELECT p.node AS src, c.node AS dst, p.hub, p.mechanism FROM m p JOIN m c ON p.hub = c.hub AND p.mechanism = c.mechanism WHERE p.publishes AND NOT c.publishes AND p.node <> c.node")
def _(v):
    table = v.spark.createDataFrame(MECHANISMS, "mechanism string, publish string, consume string, label string")
    rows = v.table("lineitem").where("l_returnflag <> 'R'")
    mechanism = F.element_at(F.array(*(F.lit(m[0]) for m in MECHANISMS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    named = rows.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hub"), mechanism.alias("hub_type"), (F.col("l_returnflag") == "A").alias("publishes"))
    edges = named.join(F.broadcast(table), F.col("hub_type") == F.col("mechanism")).select(F.when(F.col("publishes"), F.col("publish")).otherwise(F.col("consume")).alias("type"), "node", "hub", F.col("label").alias("hub_label"), "hub_type")
    return linkage.messaging(edges, table)


@query("j08_grpc_linkage", using("prod", "cons", sql=f"SELECT src, dst, hub FROM ({_HUB}) WHERE src % 3 <> dst % 3 OR src % 3 = 1"))
def _(v):
    svc = lambda df: df.withColumn("service", (F.col("node") % 3).cast("string"))
    return linkage.rpc(svc(v.produced()), svc(v.consumed()), "1").select("src", "dst", "hub")


_SCORE = "CASE WHEN rp IN ('<path>', '', '/') THEN 0 WHEN path = rp THEN 3 WHEN regexp_matches(rp, ':|\\{') AND regexp_matches(path, '^' || regexp_replace(regexp_replace(rp, '\\{[^}]+\\}', '[^/]+', 'g'), '\\.', '\\\\.', 'g') || '$') THEN 2 WHEN starts_with(path, rp) THEN 1 ELSE 0 END"


@query("j09_http_linkage", using("callers", "routes", sql=f"WITH s AS (SELECT caller, url, handler, route, method, {_SCORE} AS score FROM (SELECT c.*, r.handler, r.route, r.method, lower(r.route) AS rp FROM callers c JOIN routes r ON c.service <> r.service)) SELECT caller, url, handler, route, method, score FROM (SELECT *, max(score) OVER (PARTITION BY caller, url) AS best FROM s WHERE score > 0) WHERE score = best"))
def _(v):
    return linkage.http(v.callers(), v.routes()).select("caller", "url", "handler", "route", "method", "score")


@query("j13_unprotected_routes", using("fn", "calls", "routes", sql="SELECT handler, route AS path, method FROM routes WHERE handler NOT IN (SELECT src FROM calls JOIN fn ON fn.id = dst WHERE regexp_matches(lower(name), 'widget|auth')) ORDER BY handler, path, method LIMIT 20"))
def _(v):
    named = v.functions().withColumn("name", F.when(F.col("name").contains("widget"), "auth_check").otherwise(F.col("name")))
    return A.unprotected_routes(v.routes().select("handler", F.col("route").alias("path"), "method"), v.calls(), named).select("handler", "path", "method")


@query("j14_high_fan_in", using("calls", "res", sql="SELECT h.id, connections, fan_in FROM (SELECT src AS id, count(*) AS connections FROM res WHERE type = 'CONNECTS_TO' GROUP BY src) h JOIN (SELECT dst AS id, count(*) AS fan_in FROM calls GROUP BY dst HAVING count(*) > 5) c USING (id) ORDER BY fan_in DESC, id LIMIT 10"))
def _(v):
    return A.fan_in_of(v.calls(), v.resources().where("type = 'CONNECTS_TO'"), 5)


@query("j15_removed_routes", using("before", "after", sql="SELECT path, method FROM before WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.path = before.path AND a.method = before.method)"))
def _(v):
    return v.snapshot_routes(False).join(v.snapshot_routes(True), ["path", "method"], "left_anti")


_CHANGED = "SELECT file AS path, CASE WHEN file LIKE 'S%' THEN 'deleted' ELSE 'modified' END AS status FROM (SELECT DISTINCT file FROM fn) UNION ALL SELECT 'new.py', 'added'"
_IMPACT = f"SELECT ch.path, ch.status, count(fn.id) AS symbols, coalesce(sum(n), 0)::BIGINT AS callers, max(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END) AS infra FROM ({_CHANGED}) ch LEFT JOIN fn ON fn.file = ch.path LEFT JOIN (SELECT dst AS id, count(*) AS n FROM calls GROUP BY dst) c ON c.id = fn.id LEFT JOIN (SELECT DISTINCT src AS id FROM res) r ON r.id = fn.id GROUP BY ch.path, ch.status"
_IMPACT = f"SELECT path, status, symbols, callers, CASE WHEN status = 'deleted' THEN 40 ELSE 0 END + CASE WHEN callers > 10 THEN 30 WHEN callers > 3 THEN 15 WHEN callers > 0 THEN 5 ELSE 0 END + 20 * infra AS score FROM ({_IMPACT})"


def _changes(v: Views) -> DataFrame:
    names = v.functions().select(F.col("file").alias("path")).distinct()
    changed = names.select("path", F.when(F.col("path").startswith("S"), "deleted").otherwise("modified").alias("status")).unionByName(v.spark.createDataFrame([("new.py", "added")], "path string, status string"))
    return A.change_impact(changed, v.functions(), v.calls(), v.resources())


@query("j16_change_impact", using("fn", "calls", "res", sql=f"SELECT path, status, symbols, callers, score, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS level FROM ({_IMPACT})"))
def _(v):
    return _changes(v).select("path", "status", "symbols", "callers", "score", "level")


@query("a14_risk_histogram", using("fn", "calls", "res", sql=f"SELECT count_if(score >= 60)::BIGINT AS critical, count_if(score >= 40 AND score < 60)::BIGINT AS high, count_if(score >= 15 AND score < 40)::BIGINT AS medium, count_if(score < 15)::BIGINT AS low FROM ({_IMPACT})"))
def _(v):
    return A.risk_histogram(_changes(v))


@query("j17_service_counts", using("fn", sql="SELECT service, count(DISTINCT file) AS files, count(*) AS functions FROM fn GROUP BY service"))
def _(v):
    return symbols.service_counts(v.functions(), v.functions())


@query("j18_overview", using("fn", "calls", sql="SELECT 'Brand#2' AS service, (SELECT count(*) FROM fn WHERE service = 'Brand#2') AS functions, (SELECT count(DISTINCT file) FROM fn WHERE service = 'Brand#2') AS files, (SELECT count(*) FROM calls JOIN fn ON fn.id = src WHERE service = 'Brand#2') AS calls"))
def _(v):
    return symbols.overview(v.functions(), v.calls(), "Brand#2")


# ---- traversal

_TRAILS = "WITH RECURSIVE t AS (SELECT [src, dst] AS nodes, dst AS last, 1 AS depth FROM {edges} WHERE src = {start} UNION ALL SELECT list_append(nodes, e.dst), e.dst, depth + 1 FROM t JOIN {edges} e ON e.src = t.last WHERE depth < {depth} AND NOT list_contains(list_transform(list_zip(nodes[1:-2], nodes[2:]), lambda p: [p[1], p[2]]), [e.src, e.dst])) "
_STARTS = {"g01_impact_out": ("calls", "out", 0.0), "g01_impact_in": ("(SELECT dst AS src, src AS dst FROM calls)", "in", 0.0), "g01_impact_confident": ("(SELECT * FROM calls WHERE confidence >= 0.9)", "out", 0.9)}
for _name, (_edges, _side, _least) in _STARTS.items():

    @query(_name, using("calls", sql=_TRAILS.format(edges=_edges, start=42, depth=3) + "SELECT nodes[1] AS source, last AS target, depth FROM t"))
    def _(v, side=_side, least=_least):
        return traverse.impact(v.calls(), ids(v, 42), 3, least, side)


@query("g01_reachable", using("calls", sql="WITH RECURSIVE t AS (SELECT dst AS id, 1 AS depth FROM calls WHERE src = 42 UNION SELECT c.dst, depth + 1 FROM t JOIN calls c ON c.src = t.id WHERE depth < 4) SELECT id, min(depth) AS depth FROM t WHERE id <> 42 GROUP BY id"))
def _(v):
    return traverse.reachable(v.calls(), ids(v, 42), 4)


@query("g02_forward_flows", using("calls", sql=_TRAILS.format(edges="calls", start=42, depth=10) + "SELECT nodes AS steps, depth FROM t WHERE last NOT IN (SELECT src FROM calls) AND last <> 42 ORDER BY depth DESC, steps LIMIT 5"))
def _(v):
    return traverse.flows(v.calls(), ids(v, 42))


@query("g03_backward_flows", using("calls", sql=_TRAILS.format(edges="(SELECT dst AS src, src AS dst FROM calls)", start=42, depth=10) + "SELECT list_reverse(nodes) AS steps, depth FROM t WHERE last NOT IN (SELECT dst FROM calls) AND last <> 42 ORDER BY depth DESC, list_reverse(nodes) LIMIT 5"))
def _(v):
    return traverse.flows(v.calls(), ids(v, 42), backward=True)


@query("g04_entry_points", using("fn", "deg_in", "deg_out", sql="SELECT id, greatest(coalesce(blast_radius, 0), 1) AS outgoing, greatest(coalesce(fan_in, 0), 1) AS incoming, greatest(coalesce(blast_radius, 0), 1) - 0.5::DOUBLE * greatest(coalesce(fan_in, 0), 1) AS score FROM fn LEFT JOIN deg_in USING (id) LEFT JOIN deg_out USING (id) WHERE greatest(coalesce(fan_in, 0), 1) <= 1 ORDER BY score DESC, id LIMIT 30"))
def _(v):
    return traverse.entry_points(v.functions(), v.calls())


# The queue, the nodes seen and the finished trails of each entry, one row an entry that each round replaces.
_WALK = """
WITH RECURSIVE entries AS (
  SELECT id FROM fn LEFT JOIN deg_in USING (id) LEFT JOIN deg_out USING (id) WHERE greatest(coalesce(fan_in, 0), 1) <= 1
  ORDER BY greatest(coalesce(blast_radius, 0), 1) - 0.5::DOUBLE * greatest(coalesce(fan_in, 0), 1) DESC, id LIMIT 30
), adj AS (
  SELECT src, list_sort(list(DISTINCT dst))[:10] AS callees FROM calls WHERE src <> dst GROUP BY src
), walk(entry, queue, seen, done) USING KEY (entry) AS (
  SELECT id, [[id]], [id], [[id]][:0] FROM entries
  UNION
  SELECT entry, CASE WHEN ended THEN queue[2:] ELSE queue[2:] || list_transform(nexts, lambda n: list_append(trail, n)) END,
         CASE WHEN ended THEN seen ELSE seen || nexts END, CASE WHEN ended AND len(trail) > 1 THEN list_append(done, trail) ELSE done END
  FROM (SELECT *, len(nexts) = 0 OR len(trail) >= 10 AS ended
        FROM (SELECT w.*, w.queue[1] AS trail, list_filter(coalesce(callees, []), lambda x: NOT list_contains(w.seen, x) AND x <> w.queue[1][-1])[:3] AS nexts
              FROM walk w LEFT JOIN adj ON adj.src = w.queue[1][-1] WHERE len(w.queue) > 0 AND len(w.done) < 4))
), every AS (
  SELECT entry, unnest(done || list_filter(queue, lambda t: len(t) > 1)[:greatest(0, 4 - len(done))]) AS steps FROM walk
), traces AS (
  SELECT entry, (row_number() OVER (PARTITION BY entry ORDER BY -len(steps), steps) - 1)::INT AS trace, steps FROM every
)
"""


@query("g05_traces", using("fn", "deg_in", "deg_out", sql=_WALK + "SELECT entry, trace, steps FROM traces"))
def _(v):
    return traverse.traces(v.calls(), traverse.entry_points(v.functions(), v.calls()))


_STEPS = "SELECT entry AS process, (unnest(range(0, len(steps))))::INT AS step, unnest(steps) AS node FROM traces WHERE trace = 0"


@query("j19_process_members", using("fn", "deg_in", "deg_out", sql=_WALK + "SELECT entry AS process, steps FROM traces WHERE trace = 0"))
def _(v):
    return symbols.process_members(traverse.processes(traverse.traces(v.calls(), traverse.entry_points(v.functions(), v.calls()))))


@query("g06_process_steps", using("fn", "deg_in", "deg_out", sql=_WALK + _STEPS))
def _(v):
    return traverse.processes(traverse.traces(v.calls(), traverse.entry_points(v.functions(), v.calls())))


@query("g07_communities")
def _(v):
    return community.communities(v.service_calls())


@query("g08_community_nodes")
def _(v):
    return community.community_nodes(community.communities(v.service_calls()))


_UNDIRECTED = "SELECT f.service, least(src, dst) AS a, greatest(src, dst) AS b, arg_max(confidence, (src < dst, confidence)) AS weight FROM calls JOIN fn f ON f.id = src JOIN fn g ON g.id = dst AND g.service = f.service WHERE src <> dst GROUP BY ALL"


@query("g07_undirected", using("fn", "calls", sql=_UNDIRECTED))
def _(v):
    return community.undirected(v.service_calls())


@query("g07_label_propagation", using("fn", "calls", sql=f"WITH u AS ({_UNDIRECTED}), ends AS (SELECT service, a AS node, b AS near, weight FROM u UNION ALL SELECT service, b, a, weight FROM u), l1 AS (SELECT service, node, arg_min(label, (-weight, label)) AS label FROM (SELECT service, node, near AS label, round(sum(weight), 6) AS weight FROM ends GROUP BY ALL) GROUP BY ALL) SELECT service, node, arg_min(label, (-weight, label)) AS label FROM (SELECT b.service, b.node, l1.label, round(sum(weight), 6) AS weight FROM ends b JOIN l1 ON l1.service = b.service AND l1.node = b.near GROUP BY ALL) GROUP BY ALL"))
def _(v):
    return community.label_propagation(v.service_calls(), 2)


# ---- aggregations

_NOW = "TIMESTAMP '2024-01-30 00:00:00'"
_WINDOW = f"FROM ev WHERE ts >= {_NOW} - INTERVAL 7 DAY"


def _window(v: Views) -> DataFrame:
    return A.recent(v.events(), F.expr(_NOW), 7)


@query("a01_top_queries", using("ev", sql=f"SELECT query, count(*) AS frequency, round(avg(top_score), 6) AS avg_score {_WINDOW} GROUP BY query ORDER BY frequency DESC, query LIMIT 10"))
def _(v):
    return A.top_queries(_window(v))


@query("a02_gap_queries", using("ev", sql=f"SELECT query, count(*) AS frequency, round(avg(top_score), 6) AS avg_score {_WINDOW} AND top_score < 0.4 GROUP BY query ORDER BY frequency DESC, avg_score, query LIMIT 10"))
def _(v):
    return A.gap_queries(_window(v))


@query("a03_hot_chunks", using("ev", sql=f"SELECT top_id, count(*) AS appearances, round(avg(top_score), 6) AS avg_score {_WINDOW} GROUP BY top_id ORDER BY appearances DESC, top_id LIMIT 10"))
def _(v):
    return A.hot_chunks(_window(v))


@query("a04_total_events", using("ev", sql=f"SELECT count(*) AS n {_WINDOW}"))
def _(v):
    return _window(v).agg(F.count(F.lit(1)).alias("n"))


@query("a05_fan_in", using("deg_in", sql="SELECT * FROM deg_in ORDER BY fan_in DESC, id LIMIT 50"))
def _(v):
    return A.degree(v.calls(), "dst", "src", "fan_in")


@query("a06_blast_radius", using("deg_out", sql="SELECT * FROM deg_out ORDER BY blast_radius DESC, id LIMIT 50"))
def _(v):
    return A.degree(v.calls(), "src", "dst", "blast_radius")


@query("a07_infra_connections", using("res", sql="SELECT src AS id, count(*) AS infra_connections FROM res GROUP BY src ORDER BY infra_connections DESC, id LIMIT 50"))
def _(v):
    return v.resources().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("infra_connections")).orderBy(F.desc("infra_connections"), "id").limit(50)


def _hot_sql(infra: str) -> str:
    merged = f"SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(blast_radius, 0) AS blast_radius, coalesce(infra_connections, 0) AS infra_connections FROM (SELECT * FROM deg_in ORDER BY fan_in DESC, id LIMIT 50) FULL JOIN (SELECT * FROM deg_out ORDER BY blast_radius DESC, id LIMIT 50) USING (id) FULL JOIN ({infra}) USING (id)"
    return f"SELECT id, name, fan_in, blast_radius, infra_connections, round(0.3::DOUBLE * fan_in / mf + 0.3::DOUBLE * blast_radius / mb + 0.25::DOUBLE * fan_in / mf + 0.15::DOUBLE * infra_connections / mi, 3) AS score FROM (SELECT *, greatest(max(fan_in) OVER (), 1)::DOUBLE AS mf, greatest(max(blast_radius) OVER (), 1)::DOUBLE AS mb, greatest(max(infra_connections) OVER (), 1)::DOUBLE AS mi FROM ({merged})) JOIN fn USING (id) ORDER BY score DESC, id LIMIT 10"


_HOT_COLUMNS = ["id", "name", "fan_in", "blast_radius", "infra_connections", "score"]
_TOP_INFRA = "SELECT src AS id, count(*) AS infra_connections FROM res GROUP BY src ORDER BY infra_connections DESC, id LIMIT 50"


@query("a08_hotspots", using("fn", "deg_in", "deg_out", "res", sql=_hot_sql(_TOP_INFRA)))
def _(v):
    return A.hotspots(v.functions(), v.calls(), v.resources()).select(*_HOT_COLUMNS)


@query("a08_hotspots_calls_only", using("fn", "deg_in", "deg_out", sql=_hot_sql("SELECT NULL::BIGINT AS id, 0 AS infra_connections WHERE false")))
def _(v):
    return A.hotspots(v.functions(), v.calls()).select(*_HOT_COLUMNS)


@query("a09_node_counts", "SELECT l_returnflag AS service, l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def _(v):
    return A.node_counts(v.table("lineitem").select(F.col("l_returnflag").alias("service"), F.col("l_linestatus").alias("label")))


@query("a10_edge_counts", using("fn", "res", sql="SELECT service, type, count(*) AS n FROM res JOIN fn ON fn.id = src GROUP BY ALL"))
def _(v):
    return A.edge_counts(v.resources(), v.functions())


@query("a11_topics", using("prod", sql="SELECT DISTINCT hub AS topic FROM prod"))
def _(v):
    return v.produced().select(F.col("hub").alias("topic")).distinct()


@query("a12_repeated_calls", using("fn", "sites", sql="SELECT src, dst, sum(sites)::BIGINT AS calls FROM sites JOIN fn ON fn.id = dst WHERE name LIKE '%bolt%' GROUP BY src, dst HAVING sum(sites) > 1 ORDER BY calls DESC, src, dst LIMIT 10"))
def _(v):
    named = v.functions().withColumn("name", F.when(F.col("name").contains("bolt"), "find_bolt").otherwise("x"))
    return A.repeated_calls(v.sites(), named, 1)


@query("a13_risk_summary", "WITH r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS s FROM orders) SELECT count_if(s = 'critical')::BIGINT AS critical, count_if(s = 'high')::BIGINT AS high, count_if(s = 'medium')::BIGINT AS medium, count_if(s = 'low')::BIGINT AS low, CASE WHEN count_if(s = 'critical') > 0 THEN 'HIGH' WHEN count_if(s = 'high') > 0 THEN 'MEDIUM' WHEN count_if(s = 'medium') > 0 THEN 'LOW' ELSE 'NONE' END AS overall FROM r")
def _(v):
    p = F.col("o_orderpriority")
    return A.risk_summary(v.table("orders").select(F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low").alias("severity")))


@query("a15_capped_callers", using("fn", "calls", sql="SELECT t.name AS target, list_slice(list_sort(list(DISTINCT o.name)), 1, 3) AS names FROM calls JOIN fn t ON t.id = dst JOIN fn o ON o.id = src GROUP BY t.name"))
def _(v):
    f = v.functions()
    return symbols.grouped_neighbours(v.calls(), f.select(F.col("name").alias("target")).distinct(), f, "in")


@query("a16_language_histogram", "SELECT source AS service, lang AS language, count(*) AS n FROM documents GROUP BY ALL")
def _(v):
    return symbols.languages(v.table("documents").select(F.col("source").alias("service"), F.col("lang").alias("language")))


@query("a17_clusters", "SELECT n_regionkey AS service, n_name AS community, list_sort(list(c_custkey)) AS members FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def _(v):
    return community.clusters(v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("service"), F.col("n_name").alias("community"), F.col("c_custkey").alias("node")))


@query("a18_flow_steps", "SELECT conv_id AS process, list(role ORDER BY turn, role) AS steps FROM conversations GROUP BY conv_id")
def _(v):
    return symbols.process_members(v.table("conversations").select(F.col("conv_id").alias("process"), F.col("turn").alias("step"), F.col("role").alias("node")))


@query("a20_fingerprint", "SELECT source AS service, lang AS language, bool_or(regexp_matches(text, '(?i)grpc\\.|stub\\.|token = ')) AS odd, count(*) AS n FROM documents GROUP BY ALL")
def _(v):
    return v.table("documents").groupBy(F.col("source").alias("service"), F.col("lang").alias("language")).agg(F.bool_or(F.col("text").rlike(r"(?i)grpc\.|stub\.|token = ")).alias("odd"), F.count(F.lit(1)).alias("n"))


@query("a23_patch_totals", "SELECT count(*) AS files, sum(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))))::BIGINT AS added, sum(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))))::BIGINT AS removed FROM documents")
def _(v):
    return A.patch_totals(v.table("documents").select(F.col("text").alias("diff")))


# ---- ranking, fusion, sets


@query("k03_recent_queries", using("ev", sql="SELECT event_id, query, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM ev ORDER BY ts DESC, event_id LIMIT 10"))
def _(v):
    return A.recent_queries(v.events()).select("event_id", "query", "ts", "at")


@query("k04_newest_jobs", "SELECT o_orderkey AS job, o_orderdate AS started FROM orders ORDER BY started DESC, job LIMIT 50")
def _(v):
    return A.newest(v.table("orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("started")))


@query("k06_repo_capsule", "SELECT concat_ws(chr(10), 'Workspace: w', 'Services (10):', string_agg('  - ' || n_name || ' [r' || n_regionkey || ']', chr(10) ORDER BY n_name)) AS capsule FROM (SELECT * FROM nation ORDER BY n_name LIMIT 10)")
def _(v):
    return context.repo_capsule(v.table("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("language"), F.lit(None).cast("string").alias("path")), "w")


_SEM = f"SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM ({_L2_SQL})"
_KWR = "SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS rank FROM supplier WHERE s_acctbal > 8000 OR s_suppkey IN (SELECT id FROM sem WHERE rank % 2 = 1) ORDER BY id LIMIT 10"
_FUSED = f"WITH sem AS ({_SEM}), kwr AS ({_KWR}) SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, CASE WHEN count(DISTINCT s) = 2 THEN 'both' ELSE min(s) END AS source FROM (SELECT id, rank, 'semantic' AS s FROM sem UNION ALL SELECT id, rank, 'keyword' FROM kwr) GROUP BY id ORDER BY round(score, 9) DESC, id LIMIT 10"


def _fused(v: Views) -> DataFrame:
    near = search.ranked(_near(v).select("id", "distance"), [F.col("distance"), F.col("id")])
    odd = near.where("rank % 2 = 1").select("id")
    suppliers = v.table("supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    words = suppliers.where("s_acctbal > 8000").unionByName(suppliers.join(odd, "id", "left_semi")).select("id").distinct().orderBy("id").limit(10)
    return search.fuse(near, search.ranked(words, [F.col("id")]), 10)


@query("u01_rank_fusion", f"SELECT id, round(score, 6) AS score, source FROM ({_FUSED})")
def _(v):
    return _fused(v).select("id", F.round("score", 6).alias("score"), "source")


@query("f02_hit_boost", using("ev", sql=f"SELECT id, round(0.7::DOUBLE * score / max(score) OVER () + 0.3::DOUBLE * hits / greatest(max(hits) OVER (), 1), 6) AS boosted FROM (SELECT f.id, f.score, coalesce(n, 0) AS hits FROM ({_FUSED}) f LEFT JOIN (SELECT top_id, count(*) AS n FROM ev GROUP BY top_id) h ON h.top_id = f.id)"))
def _(v):
    return search.boost(_fused(v), stores.hit_counts(v.events())).select("id", F.round("boosted", 6).alias("boosted"))


@query("w06_first_in_file", "SELECT l_orderkey AS file, l_returnflag AS kind, min(l_partkey) AS first FROM lineitem GROUP BY ALL")
def _(v):
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("kind")).agg(F.min("l_partkey").alias("first"))


@query("w04_budget_prefix", "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank, ceil(length(text) / 4)::BIGINT AS tokens FROM documents), u AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY rank) AS used FROM r) SELECT source, doc_id, rank::INT AS rank, tokens, used::BIGINT AS used FROM u WHERE used <= 400 AND rank <= 8")
def _(v):
    rank = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    docs = v.table("documents").select("source", "doc_id", F.col("text").alias("document"), rank.alias("rank"))
    return context.budget_prefix(docs, 400, by=("source",)).select("source", "doc_id", "rank", F.col("tokens").cast("long").alias("tokens"), F.col("used").cast("long").alias("used"))


@query("w05_snippet_lines", "WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), u AS (SELECT file, line, sum(ceil((length(text) + 1) / 4)) OVER (PARTITION BY file ORDER BY line) AS used FROM l WHERE line BETWEEN 2 AND 81) SELECT file, line::INT AS line, used::BIGINT AS used FROM u WHERE used <= 200")
def _(v):
    rows = context.lines(v.table("documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))
    return context.snippet(rows, 200, start=2).select("file", "line", F.col("used").cast("long").alias("used"))


_ROUTE_DELTA = "WITH b AS (SELECT method, count(*) AS n FROM before GROUP BY method), a AS (SELECT method, count(*) AS n FROM after GROUP BY method) SELECT coalesce(b.method, a.method) AS method, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.method = b.method WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"


@query("u02_count_deltas", using("before", "after", sql=_ROUTE_DELTA))
def _(v):
    counts = lambda late: v.snapshot_routes(late).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return A.count_deltas(counts(False), counts(True), "method")


_DRIFT = "WITH gone AS (SELECT * FROM before EXCEPT SELECT * FROM after), lost AS (SELECT g.method || ' ' || g.path AS name, CASE WHEN o.other IS NULL THEN 'removed' ELSE 'method_changed' END AS change, CASE WHEN o.other IS NOT NULL THEN 'method changed from ' || g.method || ' to ' || o.other END AS detail FROM gone g LEFT JOIN (SELECT path, min(method) AS other FROM after GROUP BY path) o ON o.path = g.path), fresh AS (SELECT method || ' ' || path AS name, 'added' AS change, NULL::VARCHAR AS detail FROM (SELECT * FROM after EXCEPT SELECT * FROM before) n WHERE NOT EXISTS (SELECT 1 FROM lost WHERE change = 'method_changed' AND ends_with(lost.name, n.path))) SELECT * FROM lost UNION ALL SELECT * FROM fresh"


@query("u03_route_drift", using("before", "after", sql=_DRIFT))
def _(v):
    return A.route_drift(v.snapshot_routes(False), v.snapshot_routes(True))


@query("u05_drift_summary", using("before", "after", sql=f"SELECT count_if(change <> 'added')::BIGINT AS breaking, count(*) AS changes, count_if(change <> 'added') || ' breaking contract change(s) detected' AS summary FROM ({_DRIFT})"))
def _(v):
    return A.drift_summary(A.route_drift(v.snapshot_routes(False), v.snapshot_routes(True)))


@query("u04_topic_drift", "WITH b AS (SELECT DISTINCT l_partkey AS topic FROM lineitem WHERE l_linestatus = 'F'), a AS (SELECT DISTINCT l_partkey AS topic FROM lineitem WHERE l_linestatus = 'O') SELECT topic AS name, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT topic, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(v):
    topics = lambda df: df.select(F.col("hub").alias("topic")).distinct()
    return A.set_drift(topics(v.produced()), topics(v.consumed()), "topic")


_UPDATES = "SELECT conv_id AS task, turn, role, text AS t FROM conversations"


@query("u06_ledger", f"WITH u AS ({_UPDATES}) SELECT task, arg_max(role, turn) AS state, list(t ORDER BY turn) FILTER (WHERE role = 'assistant') AS decisions, len(list(t) FILTER (WHERE role = 'assistant'))::INT AS command_count FROM u GROUP BY task")
def _(v):
    state = context.ledger(v.ledger())
    return context.compact_ledger(state).join(state.select("task", "decisions"), "task").select("task", "state", F.when(F.size("decisions") > 0, F.col("decisions")).alias("decisions"), F.when(F.col("command_count") > 0, F.col("command_count")).alias("command_count"))


@query("u07_list_diff", "SELECT r_regionkey AS id, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS added, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS removed FROM (SELECT n_regionkey AS r_regionkey, list(n_name) FILTER (WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) AS a, list(n_name) FILTER (WHERE n_nationkey % 2 = 1 OR n_nationkey % 3 = 0) AS b FROM nation GROUP BY ALL)")
def _(v):
    n = v.table("nation")
    lists = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.collect_list(F.when(F.expr("n_nationkey % 2 = 0 OR n_nationkey % 3 = 0"), F.col("n_name"))).alias("a"), F.collect_list(F.when(F.expr("n_nationkey % 2 = 1 OR n_nationkey % 3 = 0"), F.col("n_name"))).alias("b"))
    d = A.list_diff(F.col("b"), F.col("a"))
    return lists.select("id", F.array_sort(d["added"]).alias("added"), F.array_sort(d["removed"]).alias("removed"))


# ---- scalar functions


@query("f01_rrf", "SELECT c_custkey AS id, round(1.0::DOUBLE / (60 + c_custkey), 9) AS score FROM customer")
def _(v):
    return v.table("customer").select(F.col("c_custkey").alias("id"), F.round(S.rrf(F.col("c_custkey")), 9).alias("score"))


@query("f03_escape", "SELECT page_id, regexp_replace(url, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM pages")
def _(v):
    return v.table("pages").select("page_id", S.escape_pattern(F.col("url")).alias("escaped"))


@query("f04_tokens", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, ceil(strlen(text) / 4)::BIGINT AS byte_tokens FROM documents")
def _(v):
    return v.table("documents").select("doc_id", S.estimate_tokens(F.col("text")).cast("long").alias("tokens"), S.estimate_byte_tokens(F.col("text")).cast("long").alias("byte_tokens"))


@query("f06_budget_action", "SELECT doc_id, CASE WHEN t <= 100 THEN 'pass' WHEN t <= 1000 THEN 'trim' ELSE 'offload' END AS action, t <= 9000 AS fits, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || chr(10) || '… [TRIMMED TO BUDGET]' END AS trimmed FROM (SELECT doc_id, text, ceil(length(text) / 4) AS t FROM documents)")
def _(v):
    text = F.col("text")
    return v.table("documents").select("doc_id", S.budget_action(S.estimate_tokens(text), 12000, 3000, 100).alias("action"), S.fits_budget(text, 12000, 3000).alias("fits"), S.trim_to_budget(text, 20).alias("trimmed"))


@query("f09_call_confidence", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.95 WHEN event_id % 3 = 1 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence, ['same_file', 'method_call', 'name_match'][event_id % 3 + 1] AS reason FROM events")
def _(v):
    same, callee = F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 3 == 1, "a.b").otherwise("ab")
    return v.table("events").select("event_id", S.call_confidence(same, callee).alias("confidence"), S.call_reason(same, callee).alias("reason"))


@query("f10_signature", "SELECT p_partkey AS id, p_brand || '(a: ' || p_type || ', b)' || CASE WHEN p_size % 2 = 0 THEN ' → ' || p_type ELSE '' END AS signature FROM part")
def _(v):
    params = F.array(F.struct(F.lit("a").alias("name"), F.col("p_type").alias("type")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type")))
    return v.table("part").select(F.col("p_partkey").alias("id"), S.signature(F.col("p_brand"), params, F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("signature"))


@query("f11_function_chunk", "SELECT p_partkey AS id, concat_ws(chr(10), '[go] ' || p_name, 'File: ' || p_type, 'Lines: ' || p_size || '-' || (p_size + 9), CASE WHEN p_size % 2 = 0 THEN 'Calls: x, y' END) AS document FROM part")
def _(v):
    calls = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    return v.table("part").select(F.col("p_partkey").alias("id"), S.function_chunk(F.lit("go"), F.col("p_name"), F.col("p_type"), F.col("p_size"), F.col("p_size") + 9, calls, F.array().cast("array<string>")).alias("document"))


@query("f13_normalize_path", using("pagep", sql="SELECT page_id, path FROM pagep"))
def _(v):
    return v.table("pages").select("page_id", S.normalize_path(F.col("url")).alias("path"))


@query("f16_change_risk", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 0 END + CASE WHEN o_custkey % 20 > 10 THEN 30 WHEN o_custkey % 20 > 3 THEN 15 WHEN o_custkey % 20 > 0 THEN 5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END AS score, len(list_filter([o_orderkey % 5 = 0, o_custkey % 20 > 0, o_orderstatus = 'F'], lambda x: x))::INT AS n_factors FROM orders")
def _(v):
    callers, infra, deleted = F.col("o_custkey") % 20, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 5 == 0
    return v.table("orders").select(F.col("o_orderkey").alias("id"), S.change_risk_score(callers, infra, deleted).alias("score"), F.size(S.change_risk_factors(callers, infra, deleted)).alias("n_factors"))


_SPLIT = "string_split(content, chr(10))"
_SUMMARY = f"CASE kind WHEN 'test_log' THEN CASE WHEN len(f) = 0 THEN 'Test log: ' || n || ' lines, no failures detected' ELSE 'Test log: ' || n || ' lines. Failures: ' || array_to_string(list_transform(f[:5], lambda x: trim(x)), ' | ') END WHEN 'diff' THEN 'Diff: ' || len(regexp_extract_all(content, '(?m)^diff --git')) || ' file(s) changed, +' || len(regexp_extract_all(content, '(?m)^\\+[^+]')) || ' -' || len(regexp_extract_all(content, '(?m)^-[^-]')) || ' lines' WHEN 'terminal_output' THEN CASE WHEN len(e) > 0 THEN 'Terminal output (' || n || ' lines). Errors: ' || array_to_string(list_transform(e[:3], lambda x: trim(x)), ' | ') ELSE 'Terminal output: ' || n || ' lines' END ELSE n || ' lines of ' || kind END"


@query("f20_artifact_summary", using("art", sql=f"SELECT id, kind, {_SUMMARY} AS summary, strlen(content)::INT AS size_bytes, ceil(strlen(content) / 4)::BIGINT AS tokens FROM (SELECT *, len({_SPLIT}) AS n, list_filter({_SPLIT}, lambda x: regexp_matches(x, 'FAIL|Error:|✗|✕|× ')) AS f, list_filter({_SPLIT}, lambda x: regexp_matches(x, 'error|Error|ERROR|fail|FAIL')) AS e FROM art)"))
def _(v):
    return context.artifacts(v.artifacts()).withColumn("tokens", F.col("tokens").cast("long"))


@query("f21_artifact_excerpt", using("art", sql=f"SELECT id, CASE WHEN length(array_to_string({_SPLIT}[2:4], chr(10))) > 6000 THEN left(array_to_string({_SPLIT}[2:4], chr(10)), 6000) || chr(10) || '… [continue from a later line]' ELSE array_to_string({_SPLIT}[2:4], chr(10)) END AS excerpt, 2 AS start_line, least(4, len({_SPLIT}))::INT AS end_line, len({_SPLIT})::INT AS total_lines FROM art"))
def _(v):
    return context.excerpt(v.artifacts(), 2, 4).drop("truncated")


@query("f23_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def _(v):
    return v.table("events").select("event_id", S.iso_time(F.col("ts")).alias("at"))


@query("f24_snapshot_json", "SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def _(v):
    packed = v.table("customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias("j"))
    return packed.select("id", F.from_json("j", "segment string, nation int").alias("s")).select("id", "s.segment", "s.nation")


@query("f28_staleness", "SELECT n_name AS service, CASE WHEN n_regionkey = 0 THEN 'unknown' WHEN n_nationkey % 3 = 0 THEN 'stale' ELSE 'up_to_date' END AS status FROM nation")
def _(v):
    n = v.table("nation")
    heads = n.where("n_regionkey <> 0").select(F.col("n_name").alias("service"), F.lit("h1").alias("head"), F.lit(2).alias("behind"))
    return git.staleness(n.select(F.col("n_name").alias("service"), F.when(F.col("n_nationkey") % 3 == 0, "h0").otherwise("h1").alias("last_commit")), heads).select("service", "status")


# ---- source text: files made of documents' numbers


def _sources(v: Views) -> DataFrame:
    """Two small files a document: a script that imports and calls, and the module it names."""
    n = F.col("doc_id").cast("string")
    say = lambda template: F.replace(F.lit(template), F.lit("#"), n)
    main = say('import { a# as b, c } from "./lib#";\nimport os# from "os";\nconst box: Box# = make();\nconst run = new Run#();\nclass Main# extends Base# implements IShape {\n  go(x: string): string {\n    return run.start(x);\n  }\n}\n')
    lib = say("export class Run# {\n  start(x: string): number {\n    return producer.produce('topic#', x);\n  }\n}\n")
    files = F.array(F.struct(F.concat(F.lit("src/main"), n, F.lit(".ts")).alias("path"), main.alias("content")), F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("src/lib"), n, F.lit(".ts"))).otherwise(F.concat(F.lit("src/lib"), n, F.lit("/index.ts"))).alias("path"), lib.alias("content")))
    return v.table("documents").select(F.col("source").alias("service"), F.explode(files).alias("f")).select("service", "f.path", "f.content", F.lit("typescript").alias("language"))


def _parsed(files: DataFrame) -> DataFrame:
    """Parsed records that a query reads more than once: parsed once and kept."""
    return cut(parser.parse_files(files))


_MAIN, _LIB = "'src/main' || doc_id || '.ts'", "CASE WHEN doc_id % 2 = 0 THEN 'src/lib' || doc_id || '.ts' ELSE 'src/lib' || doc_id || '/index.ts' END"


@query("f17_imports", f"SELECT source AS service, {_MAIN} AS file, unnest([1, 2]) AS line, unnest(['./lib' || doc_id, 'os']) AS module, unnest([['a' || doc_id, 'c'], ['os' || doc_id]]) AS names FROM documents")
def _(v):
    return resolve.imports(_sources(v)).select("service", "file", "line", "module", "names")


@query("j10_import_resolution", f"SELECT source AS service, {_MAIN} AS file, unnest(['./lib' || doc_id, 'os']) AS module, unnest([{_LIB}, NULL]) AS resolved, unnest([false, true]) AS external, unnest([CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.85 END, 0.6])::DOUBLE AS confidence FROM documents")
def _(v):
    files = _sources(v)
    return resolve.resolve_imports(resolve.imports(files), files).select("service", "file", "module", "resolved", "external", "confidence")


@query("a21_import_stats", "SELECT 2 * count(*) AS total, count(*) AS resolved, count(*) AS external FROM documents")
def _(v):
    files = _sources(v)
    return resolve.import_stats(resolve.resolve_imports(resolve.imports(files), files))


@query("s08_parse_phase", f"SELECT source AS service, unnest([{_MAIN}, {_LIB}]) AS file, unnest(['go', 'start']) AS name, 'method' AS kind, unnest([6, 2]) AS start_line, unnest([8, 4]) AS end_line, unnest(['string', 'number']) AS return_type FROM documents")
def _(v):
    return parser.symbols_of(parser.parse_files(_sources(v))).select("service", "file", "name", "kind", "start_line", "end_line", "return_type")


@query("s20_function_nodes", f"SELECT source AS service, unnest([{_MAIN}, {_LIB}]) AS file, unnest(['go(x: string) → string', 'start(x: string) → number']) AS signature FROM documents")
def _(v):
    return build.function_nodes(parser.symbols_of(parser.parse_files(_sources(v)))).select("service", "file", "signature")


@query("s21_call_edges", f"SELECT source AS service, unnest([{_MAIN}, {_LIB}]) AS file, unnest(['run.start', 'producer.produce']) AS callee, 0.85::DOUBLE AS confidence, 'method_call' AS reason, unnest([7, 3]) AS line FROM documents")
def _(v):
    symbols_ = parser.symbols_of(_parsed(_sources(v)))
    return build.call_edges(build.call_sites(symbols_), build.function_nodes(symbols_)).select("service", "file", "callee", "confidence", "reason", "line")


@query("s22_method_edges", f"SELECT source AS service, unnest([{_MAIN}, {_LIB}]) AS file, unnest(['Main' || doc_id, 'Run' || doc_id]) AS class, unnest(['go', 'start']) AS name FROM documents")
def _(v):
    parsed = _parsed(_sources(v))
    return build.method_edges(parser.classes_of(parsed), build.function_nodes(parser.symbols_of(parsed))).select("service", "file", "class", "name")


@query("s23_infra_edges", f"SELECT source AS service, {_LIB} AS file, 'start' AS owner, 'KafkaTopic' AS label, 'PRODUCES_TO' AS edge, 'topic' || doc_id AS target FROM documents")
def _(v):
    parsed = _parsed(_sources(v))
    return build.infra_edges(build.owned_infra(parser.infra_of(parsed), parser.symbols_of(parsed))).select("service", "file", "owner", "label", "edge", "target")


@query("j11_heritage", f"SELECT source AS service, {_MAIN} AS file, unnest(['Base' || doc_id, 'IShape']) AS base, unnest(['EXTENDS', 'IMPLEMENTS']) AS type, 0.7::DOUBLE AS confidence FROM documents")
def _(v):
    return resolve.heritage(parser.classes_of(parser.parse_files(_sources(v)))).select("service", "file", "base", "type", "confidence")


@query("f18_type_bindings", f"SELECT source AS service, {_MAIN} AS file, unnest(['box', 'run']) AS variable, unnest(['Box' || doc_id, 'Run' || doc_id]) AS type, unnest([0, 1]) AS tier FROM documents")
def _(v):
    files = _sources(v)
    parsed = _parsed(files)
    return resolve.bindings(files, parser.classes_of(parsed), parser.symbols_of(parsed)).select("service", "file", "variable", "type", "tier")


@query("j12_type_resolution", f"SELECT source AS service, {_MAIN} AS file, 'go' AS caller, 'run.start' AS callee, 'Run' || doc_id AS type, {_LIB} AS class_file, 0.9::DOUBLE AS confidence, 'constructor_inference' AS reason FROM documents")
def _(v):
    files = _sources(v)
    parsed = _parsed(files)
    syms, classes = parser.symbols_of(parsed), parser.classes_of(parsed)
    return resolve.resolve_calls(build.call_sites(syms), resolve.bindings(files, classes, syms), classes).select("service", "file", "caller", "callee", "type", "class_file", F.round("confidence", 6).alias("confidence"), "reason")


@query("f11_chunks", f"SELECT source || '::' || {_LIB} || '::start::L2' AS id, concat_ws(chr(10), '[typescript] start(x: string) → number', 'File: ' || {_LIB}, 'Lines: 2-4', 'Calls: producer.produce', 'Infrastructure: Produces to Kafka topic: topic' || doc_id) AS document FROM documents")
def _(v):
    return build.chunks(_parsed(_sources(v))).where("name = 'start'").select("id", "document")


@query("s09_openapi", "SELECT n_name AS service, unnest(['/' || n_nationkey || '/a', '/' || n_nationkey || '/a', '/b']) AS target, unnest(['GET', 'POST', 'DELETE']) AS method FROM nation")
def _(v):
    text = F.replace(F.lit('{"openapi": "3.0.0", "paths": {"/#/a": {"get": {}, "post": {"operationId": "x"}}, "/b": {"delete": {}}}}'), F.lit("#"), F.col("n_nationkey").cast("string"))
    files = v.table("nation").select(F.col("n_name").alias("service"), F.lit("openapi.json").alias("path"), text.alias("content"))
    return parser.infra_of(parser.parse_files(files)).select("service", "target", F.col("metadata")["method"].alias("method"))


@query("s10_compose", "SELECT n_name AS service, unnest(['web', 'db']) AS target, unnest(['img' || n_nationkey, '<local-build>']) AS image, unnest(['db', '']) AS needs FROM nation")
def _(v):
    text = F.replace(F.lit("services:\n  web: {image: img#, depends_on: [db]}\n  db: {build: .}\n"), F.lit("#"), F.col("n_nationkey").cast("string"))
    files = v.table("nation").select(F.col("n_name").alias("service"), F.lit("docker-compose.yml").alias("path"), text.alias("content"))
    return parser.infra_of(parser.parse_files(files)).select("service", "target", F.col("metadata")["image"].alias("image"), F.col("metadata")["dependsOn"].alias("needs"))


@query("s24_workflow_edges", "SELECT n_name AS service, 'flow' || n_nationkey AS dag, 'two' AS name, 'one' AS needs FROM nation")
def _(v):
    text = F.replace(F.lit("flow#:\n  tasks:\n    one: {operator: a.B}\n    two: {operator: c, dependencies: [one, lost]}\n"), F.lit("#"), F.col("n_nationkey").cast("string"))
    files = v.table("nation").select(F.col("n_name").alias("service"), F.lit("flows.yml").alias("path"), text.alias("content"))
    parsed = _parsed(files)
    return build.dag_edges(parser.tasks_of(parsed), build.function_nodes(parser.symbols_of(parsed)))["DEPENDS_ON"].select("service", "dag", "name", "needs")


@query("s25_sync_metadata", "SELECT n_name AS service, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS last_commit, n_regionkey::BIGINT AS file_count FROM nation")
def _(v):
    n = v.table("nation")
    old = n.select(F.col("n_name").alias("service"), F.lit("old").alias("last_commit"), F.lit(0).cast("long").alias("file_count"))
    runs = n.select(F.col("n_name").alias("service"), F.when(F.col("n_nationkey") % 2 == 0, "new").alias("commit"), F.col("n_regionkey").cast("long").alias("files"))
    return source_files.sync_metadata(old, runs).select("service", "last_commit", "file_count")


@query("s26_snapshot", "SELECT n_regionkey::VARCHAR AS service, count(*) AS nations, list_sort(list(DISTINCT n_name)) AS topics FROM nation GROUP BY ALL")
def _(v):
    n = v.table("nation").select(F.col("n_regionkey").cast("string").alias("service"), F.col("n_name").alias("topic"))
    counts = lambda key: n.groupBy("service", F.lit("Nation").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    snap = A.snapshot(counts("label"), counts("type"), n.select("service", F.col("topic").alias("path"), F.lit("GET").alias("method")), n.select("service", F.col("topic").alias("endpoint")), n, "c")
    return snap.select("service", F.col("node_counts")["Nation"].alias("nations"), F.col("kafka_topics").alias("topics"))


@query("f15_route_score", using("pagep", sql="SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 3 WHEN page_id % 4 = 1 AND path LIKE '/%/%' AND path NOT LIKE '/%/%/%' THEN 2 WHEN page_id % 4 = 2 THEN CASE WHEN length(path) = length(left(path, 3)) THEN 3 ELSE 1 END ELSE 0 END AS score FROM pagep"))
def _(v):
    path = S.normalize_path(F.col("url"))
    k = F.col("page_id") % 4
    route = F.when(k == 0, path).when(k == 1, F.concat(F.regexp_extract(path, "^(/[^/]*)", 1), F.lit("/:id"))).when(k == 2, F.left(path, F.lit(3))).otherwise(F.lit("/"))
    return v.table("pages").select("page_id", S.route_score(path, route).alias("score"))


@query("f19_clean_docstring", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'First ' || doc_id || chr(10) || 'second' ELSE 'only ' || doc_id END AS doc FROM documents")
def _(v):
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/**\n * First "), n, F.lit("\n * second\n */"))).otherwise(F.concat(F.lit("# only "), n))
    return v.table("documents").select("doc_id", S.clean_docstring(raw).alias("doc"))


@query("f25_promoted_markdown", "SELECT event_type AS query, concat_ws(chr(10), '# ' || event_type, '', 'Asked ' || count(*) || ' times.') AS body FROM events GROUP BY event_type")
def _(v):
    return stores.pattern_files(v.events().groupBy("query").agg(F.count(F.lit(1)).alias("frequency"))).select("query", "body")


@query("w08_binding_precedence", "SELECT l_orderkey AS file, arg_min(l_partkey, (l_returnflag, l_linenumber, l_partkey)) AS kind FROM lineitem GROUP BY l_orderkey")
def _(v):
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.min_by("l_partkey", F.struct("l_returnflag", "l_linenumber", "l_partkey")).alias("kind"))


# ---- what earlier queries show in part only


@query("p03_keyword_core", using("kw", sql="SELECT service || '::' || file || '::' || name AS id, concat_ws(chr(10), '[' || label || '] ' || name, 'File: ' || file, CASE WHEN docstring <> '' THEN 'Doc: ' || docstring END) AS document, 0.0::DOUBLE AS score FROM kw WHERE contains(lower(name), 'src1_') OR contains(lower(file), 'src1_') OR contains(lower(coalesce(docstring, '')), 'src1_') ORDER BY label || ':' || file || ':' || name LIMIT 20"))
def _(v):
    return search.keyword_core(v.keyword_nodes(), "SRC1_", 20).select("id", "document", "score")


@query("s15_upsert_chunks", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new ' || vec_id ELSE 'old' END AS document FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new ' || (vec_id + 1000000) FROM embeddings WHERE vec_id % 5 = 0")
def _(v):
    old = v.chunks().select("id", F.lit("old").alias("document"))
    new = old.where("id % 3 = 0").select("id").unionByName(old.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id")))
    fresh = new.select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("document"))
    return stores.upsert_chunks(old, fresh.unionByName(new.select("id", F.lit("a").alias("document"))))


@query("p18_interfaces", "SELECT p_partkey AS id, coalesce(p_size % 3 <> 0 AND regexp_matches(CASE WHEN p_partkey % 2 = 0 THEN 'I' ELSE '' END || upper(left(p_type, 1)) || p_brand, '^I[A-Z]'), false) AS interface FROM part")
def _(v):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "I").otherwise(""), F.upper(F.left("p_type", F.lit(1))), F.col("p_brand"))
    language = F.element_at(F.array(*map(F.lit, ("go", "csharp", "typescript"))), (F.col("p_size") % 3 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), F.coalesce(S.is_interface(name, language), F.lit(False)).alias("interface"))


@query("s19_services", "SELECT source AS name, ['typescript'] AS languages, 2 * count(*) AS file_count FROM documents GROUP BY source")
def _(v):
    return build.service_nodes(parser.parse_files(_sources(v)))


@query("s19_files", f"SELECT source AS service, unnest([{_MAIN}, {_LIB}]) AS path, 'typescript' AS language FROM documents")
def _(v):
    return build.file_nodes(parser.parse_files(_sources(v)))


@query("a22_heritage_stats", "SELECT count(*) AS extends, count(*) AS implements, 0::BIGINT AS resolved FROM documents")
def _(v):
    return resolve.heritage_stats(resolve.heritage(parser.classes_of(parser.parse_files(_sources(v)))))


@query("f05_byte_tokens", "SELECT doc_id AS id, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens FROM documents")
def _(v):
    return v.table("documents").select(F.col("doc_id").alias("id"), S.estimate_byte_tokens(F.col("text")).alias("tokens"))


@query("f07_limit_output", "SELECT doc_id AS id, CASE WHEN t <= 100 THEN 'pass' WHEN t <= 1000 THEN 'trim' ELSE 'offload' END AS action, CASE WHEN t <= 100 THEN text WHEN t <= 1000 THEN left(text, 400) || '… [TRUNCATED]' ELSE left(text, 400) || '… [OFFLOAD REQUIRED]' END AS content FROM (SELECT doc_id, text, ceil(length(text) / 4) AS t FROM documents)")
def _(v):
    return context.limit_output(v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 12_000, 3_000, 100)


@query("f08_budget_fits", "SELECT doc_id AS id, ceil(length(text) / 4) <= 700 AS fits, CASE WHEN length(text) <= 2800 THEN text ELSE left(text, 2800) || chr(10) || '… [TRIMMED TO BUDGET]' END AS trimmed FROM documents")
def _(v):
    return v.table("documents").select(F.col("doc_id").alias("id"), S.fits_budget(F.col("text"), 1000, 300).alias("fits"), S.trim_to_budget(F.col("text"), 700).alias("trimmed"))


_FLOW = "flow#:\n  description: nightly load\n  schedule_interval: daily\n  tasks:\n    one: {operator: a.b.BashOperator, bash_command: run}\n    two: {operator: c.PythonOperator, python_callable_name: go, dependencies: [one]}\n"


@query("f12_flow_chunks", "SELECT unnest([n_name || '::flows.yml::dag::flow' || n_nationkey, n_name || '::flows.yml::task::flow' || n_nationkey || '::one', n_name || '::flows.yml::task::flow' || n_nationkey || '::two']) AS id, unnest([concat_ws(chr(10), '[yaml] DAG: flow' || n_nationkey, 'File: flows.yml', 'Description: nightly load', 'Schedule: daily', 'Tasks: one, two'), concat_ws(chr(10), '[yaml] Task: one (BashOperator)', 'DAG: flow' || n_nationkey, 'File: flows.yml', 'Operator: a.b.BashOperator', 'Bash command: run'), concat_ws(chr(10), '[yaml] Task: two (PythonOperator)', 'DAG: flow' || n_nationkey, 'File: flows.yml', 'Operator: c.PythonOperator', 'Calls: go', 'Dependencies: one')]) AS document, unnest([false, true, false]) AS has_infra FROM nation")
def _(v):
    text = F.replace(F.lit(_FLOW), F.lit("#"), F.col("n_nationkey").cast("string"))
    files = v.table("nation").select(F.col("n_name").alias("service"), F.lit("flows.yml").alias("path"), text.alias("content"))
    return build.chunks(parser.parse_files(files)).select("id", "document", "has_infra")


@query("f29_compact_ledger", f"WITH u AS ({_UPDATES}) SELECT task, arg_max(t, turn) FILTER (WHERE role = 'user') AS objective, count_if(role = 'assistant')::INT AS decision_count, count_if(role = 'assistant')::INT AS command_count FROM u GROUP BY task")
def _(v):
    return context.compact_ledger(context.ledger(v.ledger())).select("task", "objective", F.greatest("decision_count", F.lit(0)).alias("decision_count"), F.greatest("command_count", F.lit(0)).alias("command_count"))


@query("j02_neighbour_kinds", using("res", "fn", sql="SELECT type, dst AS id FROM res JOIN fn ON fn.id = src WHERE service = 'Brand#11' GROUP BY ALL"))
def _(v):
    starts = v.functions().where("service = 'Brand#11'").select("id")
    parts = [symbols.one_hop(v.resources(), kind, starts).withColumn("type", F.lit(kind)) for kind in ("CONNECTS_TO", "PRODUCES_TO", "CONSUMES_FROM")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("type", "id")


@query("j03_symbol_context", using("fn", "calls", sql="WITH s AS (SELECT * FROM fn WHERE id = 42) SELECT f.id, max(confidence) AS confidence, 'caller' AS facet FROM calls c JOIN s ON s.id = c.dst JOIN fn f ON f.id = c.src GROUP BY f.id UNION ALL SELECT f.id, max(confidence), 'callee' FROM calls c JOIN s ON s.id = c.src JOIN fn f ON f.id = c.dst GROUP BY f.id"))
def _(v):
    f, calls = v.functions(), v.calls()
    starts = f.where("id = 42")
    side = lambda where, facet: symbols.neighbours(calls, f, starts, where, 1_000_000).select("id", "confidence", F.lit(facet).alias("facet"))
    return side("in", "caller").unionByName(side("out", "callee"))

