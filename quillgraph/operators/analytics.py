"""Hotspots, risks, snapshots and their differences, schema quality, query-log reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalar as S
from quillgraph.schemas import SCHEMA_VERSION


def degree(edges: DataFrame, by: str, other: str, name: str, top: int = 50) -> DataFrame:
    """Distinct neighbours of each node, the ``top`` with the most (ties by id)."""
    return edges.select(by, other).distinct().groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), "id").limit(top)


def hotspots(functions: DataFrame, edges: DataFrame, infra: DataFrame | None = None, top: int = 10, each: int = 50) -> DataFrame:
    """Functions by 0.3 churn + 0.3 blast radius + 0.25 fan-in + 0.15 infrastructure, each over the largest; churn stands in as fan-in.

    Each measure is cut to its ``each`` largest before they are joined, so
    what follows is a few rows.
    """
    fan_in, blast = degree(edges, "dst", "src", "fan_in", each), degree(edges, "src", "dst", "blast_radius", each)
    rows = fan_in.join(blast, "id", "full_outer")
    if infra is None:
        rows = rows.withColumn("infra_connections", F.lit(0))
    else:
        rows = rows.join(infra.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("infra_connections")).orderBy(F.desc("infra_connections"), "id").limit(each), "id", "full_outer")
    measures = ("fan_in", "blast_radius", "infra_connections")
    filled = rows.select("id", *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))
    most = {m: F.greatest(F.max(m).over(Window.partitionBy()), F.lit(1)) for m in measures}
    norm = {m: F.col(m) / most[m] for m in measures}
    raw = 0.3 * norm["fan_in"] + 0.3 * norm["blast_radius"] + 0.25 * norm["fan_in"] + 0.15 * norm["infra_connections"]
    counted = lambda what, m, of: F.concat(F.lit(f"{what} ("), F.col(m).cast("string"), F.lit(f" {of})" if of else ")"))
    reasons = F.array_compact(F.array(F.when(F.col("fan_in") > most["fan_in"] * 0.6, counted("high fan-in", "fan_in", "callers")), F.when(F.col("blast_radius") > most["blast_radius"] * 0.6, counted("large blast radius", "blast_radius", "callees")), F.when(F.col("infra_connections") > 0, counted("infra connections", "infra_connections", ""))))
    scored = filled.select("id", *measures, F.round(raw, 3).alias("score"), F.round(norm["fan_in"], 3).alias("churn"), reasons.alias("reasons"))
    return scored.join(functions.select("id", "name", "file", "service"), "id").orderBy(F.desc("score"), "id").limit(top)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("service", "label").agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges of each type from the functions of each service."""
    return edges.join(functions.select(F.col("id").alias("src"), "service"), "src").groupBy("service", "type").agg(F.count(F.lit(1)).alias("n"))


def as_map(counts: DataFrame, key: str) -> DataFrame:
    """service and a map of key to count."""
    return counts.groupBy("service").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def snapshot(nodes: DataFrame, edges: DataFrame, routes: DataFrame, rpc: DataFrame, topics: DataFrame, commit: str) -> DataFrame:
    """One row a service: counts as maps, contracts as sorted arrays."""
    by = lambda df, value, name: df.groupBy("service").agg(F.array_sort(F.collect_set(value)).alias(name))
    parts = [as_map(nodes, "label").withColumnRenamed("counts", "node_counts"), as_map(edges, "type").withColumnRenamed("counts", "edge_counts"), by(routes, F.struct("path", "method"), "api_routes"), by(rpc, F.col("endpoint"), "grpc_endpoints"), by(topics, F.col("topic"), "kafka_topics")]
    joined = reduce(lambda a, b: a.join(b, "service", "full_outer"), parts)
    return joined.select("service", F.lit(commit).alias("commit"), F.current_timestamp().alias("taken_at"), *joined.columns[1:])


def to_json(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("service", "commit", F.to_json(F.struct(*snapshots.columns)).alias("snapshot"))


def count_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changed counts (key, n) of two snapshots; a missing key is 0."""
    joined = before.select(key, F.col("n").alias("old")).join(after.select(key, F.col("n").alias("new")), key, "full_outer")
    return joined.select(key, (F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("delta")).where("delta <> 0")


def route_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change, detail) of routes (path, method): removed, method_changed (another method of the path is there), or added.

    An added route isn't reported where a changed one covers it: its name
    ends with the route's path.
    """
    gone = before.join(after, ["path", "method"], "left_anti")
    others = after.groupBy("path").agg(F.min("method").alias("other"), F.collect_set("method").alias("methods"))
    named = F.concat_ws(" ", "method", "path")
    lost = gone.join(others, "path", "left").select("path", named.alias("name"), F.when(F.col("other").isNull(), "removed").otherwise("method_changed").alias("change"), F.when(F.col("other").isNotNull(), F.concat(F.lit("method changed from "), "method", F.lit(" to "), "other")).alias("detail"))
    changed = lost.where("change = 'method_changed'").select(F.col("name").alias("covered"))
    # A name ends with a path exactly if the path is one of its suffixes.
    covered = changed.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("covered")), lambda i: F.substr(F.col("covered"), i))).alias("path")).distinct()
    new = after.join(before, ["path", "method"], "left_anti").join(covered, "path", "left_anti")
    return lost.select("name", "change", "detail").unionByName(new.select(named.alias("name"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("detail")))


def set_drift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    gone, new = before.select(column).exceptAll(after.select(column)).distinct(), after.select(column).exceptAll(before.select(column)).distinct()
    return gone.select(F.col(column).alias("name"), F.lit("removed").alias("change")).unionByName(new.select(F.col(column).alias("name"), F.lit("added").alias("change")))


def drift_summary(drift: DataFrame) -> DataFrame:
    breaking = F.count_if(F.col("change").isin("removed", "method_changed"))
    text = F.when(breaking > 0, F.concat(breaking.cast("string"), F.lit(" breaking contract change(s) detected"))).when(F.count(F.lit(1)) > 0, F.concat(F.count(F.lit(1)).cast("string"), F.lit(" contract change(s) (additions only)"))).otherwise("No contract drift")
    return drift.agg(breaking.alias("breaking"), F.count(F.lit(1)).alias("changes"), text.alias("summary"))


def list_diff(before: Column, after: Column) -> Column:
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"), F.array_intersect(before, after).alias("unchanged"))


def unprotected_routes(exposes: DataFrame, edges: DataFrame, functions: DataFrame, limit: int = 20) -> DataFrame:
    """Routes whose handler calls nothing named like auth, jwt, permission or middleware."""
    guards = functions.where(F.lower("name").rlike("auth|jwt|permission|middleware")).select(F.col("id").alias("dst"))
    guarded = edges.join(guards, "dst", "left_semi").select("src")
    return exposes.join(guarded, exposes.handler == guarded.src, "left_anti").orderBy("handler", "path", "method").limit(limit)


def fan_in_of(edges: DataFrame, resources: DataFrame, least: int = 10, limit: int = 10) -> DataFrame:
    """Functions with resource edges and more than ``least`` distinct callers."""
    held = resources.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("connections"))
    callers = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return held.join(callers.where(F.col("fan_in") > least), "id").orderBy(F.desc("fan_in"), "id").limit(limit)


def repeated_calls(sites: DataFrame, functions: DataFrame, more_than: int = 3, limit: int = 10) -> DataFrame:
    """Pairs in which a function calls one named like a query more than ``more_than`` times; needs call sites with multiplicity."""
    lookups = functions.where(F.col("name").rlike("query|find|fetch")).select(F.col("id").alias("dst"))
    return sites.join(lookups, "dst", "left_semi").groupBy("src", "dst").agg(F.sum("sites").alias("calls")).where(F.col("calls") > more_than).orderBy(F.desc("calls"), "src", "dst").limit(limit)


RISK = ["id", "type", "severity", "score", "title"]


def risk_items(spot: DataFrame, unguarded: DataFrame, fan_in: DataFrame, drift: DataFrame, repeated: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All risks of at least the threshold, by score."""
    row = lambda df, i, kind, severity, score, title: df.select(i.alias("id"), F.lit(kind).alias("type"), severity.alias("severity"), score.cast("double").alias("score"), title.alias("title"))
    route = F.concat_ws(":", "method", "path")
    name = lambda x: F.col(x).cast("string")
    parts = [
        row(unguarded, F.concat(F.lit("security::unprotected-route::"), route), "security", F.lit("high"), F.lit(0.75), F.concat(F.lit("Potentially unprotected route: "), F.concat_ws(" ", "method", "path"))),
        row(fan_in, F.concat(F.lit("security::high-fanin-db::"), name("id")), "security", F.lit("medium"), F.lit(0.55), F.concat(F.lit("High fan-in DB function: "), name("id"))),
        row(spot.where(F.col("score") >= threshold), F.concat(F.lit("stability::hotspot::"), name("id")), "stability", F.when(F.col("score") >= 0.85, "critical").otherwise("high"), F.col("score"), F.concat(F.lit("Stability hotspot: "), name("name"))),
        row(drift, F.concat(F.lit("stability::contract-drift::"), route), "stability", F.lit("critical"), F.lit(0.95), F.concat(F.lit("Contract drift: "), F.concat_ws(" ", "method", "path"), F.lit(" was removed"))),
        row(repeated, F.concat(F.lit("performance::n-plus-one::"), name("src")), "performance", F.lit("medium"), F.lit(0.5), F.concat(F.lit("Potential N+1: "), name("src"))),
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id")


def risk_summary(items: DataFrame) -> DataFrame:
    levels = {s: F.count_if(F.col("severity") == s) for s in ("critical", "high", "medium", "low")}
    overall = F.when(levels["critical"] > 0, "HIGH").when(levels["high"] > 0, "MEDIUM").when(levels["medium"] > 0, "LOW").otherwise("NONE")
    return items.agg(*(c.alias(s) for s, c in levels.items()), overall.alias("overall"))


def change_impact(changed: DataFrame, functions: DataFrame, edges: DataFrame, infra: DataFrame) -> DataFrame:
    """Risk of each changed file (path, status): its functions, their callers, whether they touch infrastructure. One join for all files."""
    own = functions.select(F.col("file").alias("path"), "id")
    callers = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    touching = infra.select(F.col("src").alias("id")).distinct().withColumn("infra", F.lit(1))
    joined = changed.join(own, "path", "left").join(callers, "id", "left").join(touching, "id", "left")
    per_file = joined.groupBy("path", "status").agg(F.count("id").alias("symbols"), F.coalesce(F.sum("callers"), F.lit(0)).alias("callers"), F.coalesce(F.max("infra"), F.lit(0)).alias("infra"))
    touched, gone = F.col("infra") > 0, F.col("status") == "deleted"
    scored = per_file.withColumn("score", S.change_risk_score(F.col("callers"), touched, gone))
    return scored.select("path", "status", "symbols", "callers", "score", S.change_risk_level(F.col("score")).alias("level"), S.change_risk_factors(F.col("callers"), touched, gone).alias("factors")).orderBy(F.desc("score"), "path")


def risk_histogram(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("level") == s).alias(s) for s in ("critical", "high", "medium", "low")))


def schema_violations(nodes: DataFrame, limit: int = 100) -> DataFrame:
    """Nodes that lack a field every node carries, at most ``limit`` a label, with the missing names."""
    fields = ("schema_version", "first_seen", "last_seen", "source")
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return nodes.withColumn("missing", missing).where(F.size("missing") > 0).withColumn("place", place).where(F.col("place") <= limit).select("label", "id", "missing")


def wrong_versions(nodes: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    return nodes.where(F.col("schema_version").isNotNull() & (F.col("schema_version") != version)).agg(F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, now: Column, days: int) -> DataFrame:
    return events.where(F.col("ts") >= S.since(now, days))


def top_queries(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.groupBy("query").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("top_score"), 6).alias("avg_score")).orderBy(F.desc("frequency"), "query").limit(limit)


def gap_queries(events: DataFrame, below: float = 0.4, limit: int = 10) -> DataFrame:
    """Queries of events whose best result scored below the limit."""
    return events.where(F.col("top_score") < below).groupBy("query").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("top_score"), 6).alias("avg_score")).orderBy(F.desc("frequency"), "avg_score", "query").limit(limit)


def hot_chunks(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.where(F.col("top_id").isNotNull()).groupBy("top_id").agg(F.count(F.lit(1)).alias("appearances"), F.round(F.avg("top_score"), 6).alias("avg_score")).orderBy(F.desc("appearances"), "top_id").limit(limit)


def recent_queries(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.orderBy(F.desc("ts"), "event_id").limit(limit).withColumn("at", S.iso_time(F.col("ts")))


def newest(jobs: DataFrame, keep: int = 50) -> DataFrame:
    """Jobs without the oldest ones beyond ``keep``."""
    return jobs.orderBy(F.desc("started"), "job").limit(keep)


#: Patterns of frameworks, data stores and transports.
FRAMEWORKS = {
    "express": r"\brequire\(['\"]express['\"]\)|from ['\"]express['\"]", "nestjs": r"from ['\"]@nestjs/", "fastapi": r"from fastapi import|FastAPI\(\)", "django": r"from django|django\.urls", "flask": r"from flask import|Flask\(__name__\)",
    "spring": r"@SpringBootApplication|@RestController", "gin": r"gin\.Default\(\)|gin\.New\(\)", "fiber": r"fiber\.New\(\)", "laravel": r"use Illuminate\\|artisan", "airflow": r"from airflow|DAG\(|PythonOperator",
}
DATASTORES = {"postgres": "postgres|postgresql|pg\\.Pool|psycopg2|asyncpg", "mongodb": "mongodb|mongoose|pymongo|MongoClient", "elasticsearch": "elasticsearch|elastic_search", "redis": r"redis\.Redis|aioredis|ioredis|redis\.from_url", "mysql": "mysql|pymysql|aiomysql"}
TRANSPORTS = {"http": r"axios|fetch\(|requests\.get|requests\.post|httpx", "grpc": r"grpc\.|proto\.load|stub\.|GrpcModule", "kafka": r"KafkaProducer|kafka\.producer|confluent_kafka|aiokafka", "rabbitmq": r"pika\.BlockingConnection|amqp|RabbitmqModule", "redis_pub": r"\.publish\(|redis.*pubsub", "sqs": "boto3.*sqs|SQSClient|send_message", "nats": r"nats\.connect|NatsModule"}


def fingerprint(files: DataFrame) -> DataFrame:
    """Frameworks, data stores, transports, languages and deployment of each service, from (service, path, language, content)."""
    found = lambda table, flag: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*(F.when(F.col("content").rlike(flag + p), F.lit(n)) for n, p in table.items())))))))
    k8s, compose = F.bool_or(F.col("path").rlike(r"k8s|kubernetes|helm|Chart\.yaml")), F.bool_or(F.col("path").contains("docker-compose"))
    return files.groupBy("service").agg(found(FRAMEWORKS, "").alias("frameworks"), found(DATASTORES, "(?i)").alias("datastores"), found(TRANSPORTS, "(?i)").alias("transports"), F.array_sort(F.collect_set("language")).alias("languages"), F.when(k8s, "k8s").when(compose, "docker_compose").otherwise("unknown").alias("deployment"))


def patch_totals(patches: DataFrame) -> DataFrame:
    """Lines added and removed over patches (column diff)."""
    count = lambda sign: F.sum(F.size(F.filter(F.split("diff", "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))))
    return patches.agg(F.count(F.lit(1)).alias("files"), count("+").alias("added"), count("-").alias("removed"))
