"""The property graph from parsed records: node and edge tables, search chunks.

Every merge is order-independent: a key's rows are summed to one (newest by
sequence, earliest first_seen), and a name that several definitions share
links to all of them, a stub standing in only where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalar as S
from quillgraph.parse import parser
from quillgraph.schemas import INFRA, SCHEMA_VERSION


def stamped(nodes: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    """The fields that every node carries."""
    now = F.current_timestamp() if now is None else now
    return nodes.select("*", F.lit(SCHEMA_VERSION).alias("schema_version"), now.alias("first_seen"), now.alias("last_seen"), F.lit(source).alias("source"))


def service_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.col("service").alias("name")).agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count(F.lit(1)).alias("file_count"))


def file_nodes(parsed: DataFrame) -> DataFrame:
    """Files by service and path; each BELONGS_TO its service."""
    return parsed.select("service", F.col("file").alias("path"), "language").dropDuplicates(["service", "path"])


def function_nodes(symbols: DataFrame) -> DataFrame:
    """Functions by (name, file, service); of equal ones the last in the file."""
    rows = symbols.select("service", "file", "name", "ordinal", F.struct("kind", S.signature(F.col("name"), F.col("params"), F.col("return_type")).alias("signature"), "return_type", F.coalesce("docstring", F.lit("")).alias("docstring"), "start_line", "end_line", "language").alias("v"))
    return rows.groupBy("service", "file", "name").agg(F.max_by("v", "ordinal").alias("v")).select("service", "file", "name", "v.*")


def call_sites(symbols: DataFrame) -> DataFrame:
    """Every call with its caller, with multiplicity, and whether the callee is defined in the same file."""
    sites = symbols.select("service", "file", F.col("name").alias("caller"), F.explode("calls").alias("c")).select("service", "file", "caller", F.col("c.name").alias("callee"), F.col("c.line").alias("line"))
    local = symbols.select("service", "file", F.col("name").alias("callee")).distinct().withColumn("same_file", F.lit(True))
    joined = sites.join(local, ["service", "file", "callee"], "left").withColumn("same_file", F.coalesce("same_file", F.lit(False)))
    return joined.withColumn("confidence", S.call_confidence(F.col("same_file"), F.col("callee"))).withColumn("reason", S.call_reason(F.col("same_file"), F.col("callee")))


def call_edges(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """CALLS edges to every function with the callee's name, in any service; to a stub (null file) without one."""
    merged = sites.groupBy("service", "file", "caller", "callee").agg(F.max("confidence").alias("confidence"), F.max_by("reason", "confidence").alias("reason"), F.max("line").alias("line"), F.count(F.lit(1)).alias("sites"))
    targets = functions.select(F.col("name").alias("callee"), F.col("file").alias("callee_file"), F.col("service").alias("callee_service"))
    return merged.join(targets, "callee", "left")


def stubs(edges: DataFrame) -> DataFrame:
    """Names that are called but defined nowhere."""
    return edges.where(F.col("callee_file").isNull()).select(F.col("callee").alias("name")).distinct()


def class_nodes(classes: DataFrame) -> DataFrame:
    rows = classes.select("service", "file", "name", "ordinal", F.struct("bases", "methods", "docstring", "start_line", "end_line", "language").alias("v"))
    return rows.groupBy("service", "file", "name").agg(F.max_by("v", "ordinal").alias("v")).select("service", "file", "name", "v.*")


def inherits_edges(classes: DataFrame) -> DataFrame:
    """INHERITS to every class of the base's name, or a stub."""
    based = classes.select("service", "file", "name", F.explode("bases").alias("base")).distinct()
    targets = classes.select(F.col("name").alias("base"), F.col("file").alias("base_file"), F.col("service").alias("base_service")).distinct()
    return based.join(targets, "base", "left").withColumn("confidence", F.lit(0.9))


def method_edges(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """METHOD_OF for methods that are functions of the class's file."""
    methods = classes.select("service", "file", F.col("name").alias("class"), F.explode("methods").alias("name")).distinct()
    return methods.join(functions.select("service", "file", "name"), ["service", "file", "name"])


def owned_infra(infra: DataFrame, functions: DataFrame) -> DataFrame:
    """Each pattern with the first function of its file whose lines contain it (null: the file owns it).

    The owner is looked for once for each line that has a pattern, among one
    function of each range of lines (equi-join on the file, the range as
    residual), and then given to the line's patterns.
    """
    pattern = infra.withColumn("_row", F.struct("kind", "target", "detail", "metadata"))
    ranges = functions.groupBy("service", "file", "start_line", "end_line").agg(F.min(F.struct(F.col("name").alias("owner"))).alias("first")).select("service", "file", "start_line", "end_line", "first.owner")
    place = ["service", "file", "line"]
    inside = infra.select(*place).distinct().join(ranges, ["service", "file"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    owners = inside.groupBy(*place).agg(F.min_by("owner", F.struct("start_line", F.negative("end_line"), "owner")).alias("owner"))
    once = pattern.groupBy(*place, "ordinal").agg(F.first("_row").alias("r"))
    return once.join(owners, place, "left").select(*place, "owner", "r.kind", "r.target", "r.detail", "r.metadata")


def infra_dimension(spark: SparkSession) -> DataFrame:
    """kind, label, edge and broker or database type: one row for each of the fixed kinds."""
    return spark.createDataFrame([(k, *v) for k, v in INFRA.items()], "kind string, label string, edge string, type string")


def infra_edges(owned: DataFrame) -> DataFrame:
    """Edges from owner to resource for the kinds with a label; the dimension is a fixed table and broadcast."""
    return owned.join(F.broadcast(infra_dimension(owned.sparkSession)), "kind")


def candidates(owned: DataFrame) -> DataFrame:
    """Patterns of other kinds, for review: keyed service::file::pattern."""
    known = F.col("kind").isin(*INFRA)
    return owned.where(~known).select(F.concat_ws("::", "service", "file", "kind").alias("id"), "service", "file", "line", F.col("kind").alias("pattern"), F.col("detail").alias("raw_code"), F.lit(0.5).alias("confidence"), F.lit("pending").alias("status"), F.current_timestamp().alias("detected_at")).dropDuplicates(["id"])


def review(queue: DataFrame, candidate: str, status: str, approved_as: str | None = None, reason: str | None = None) -> DataFrame:
    """The queue with one candidate promoted or rejected."""
    hit = F.col("id") == candidate
    out = queue.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    return out.withColumn("approved_as", F.when(hit, F.lit(approved_as))).withColumn("reason", F.when(hit, F.lit(reason)))


def reviewed(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """The queue with kept reviews (candidate, status, approved_as, reason; at most one a candidate); others stay as they are."""
    found = reviews.select(F.col("candidate").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("status", "approved_as", "reason")))
    joined = queue.join(found, "id", "left")
    before = lambda c: F.col(c) if c in queue.columns else F.lit(None).cast("string")
    hit = F.col("_status").isNotNull()
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(before(c)) for c in ("status", "approved_as", "reason")}
    return joined.withColumns(new).drop("_status", "_approved_as", "_reason")


def open_candidates(queue: DataFrame, service: str = "", limit: int = 50) -> DataFrame:
    return queue.where((F.lit(service) == "") | (F.col("service") == service)).orderBy(F.desc("detected_at"), "id").limit(limit)


def dag_edges(tasks: DataFrame, functions: DataFrame) -> dict[str, DataFrame]:
    """CONTAINS, DEPENDS_ON and INVOKES of workflow tasks."""
    depends = tasks.select("service", "dag", "name", F.explode("dependencies").alias("needs")).distinct()
    known = tasks.select("service", "dag", F.col("name").alias("needs")).distinct()
    invoked = tasks.where(F.col("callable_name").isNotNull()).select("service", "dag", "name", F.col("callable_name").alias("callee"))
    targets = functions.select(F.col("name").alias("callee"), F.col("file").alias("callee_file"), F.col("service").alias("callee_service"))
    return {"CONTAINS": tasks.select("service", "dag", "name").distinct(), "DEPENDS_ON": depends.join(known, ["service", "dag", "needs"]), "INVOKES": invoked.join(targets, "callee", "left")}


def chunks(parsed: DataFrame) -> DataFrame:
    """Search chunks (id, document, service, file, language, name, start_line, end_line, has_infra) of functions, classes, workflows and tasks."""
    symbols, classes, tasks = parser.symbols_of(parsed), parser.classes_of(parsed), parser.tasks_of(parsed)
    owned = owned_infra(parser.infra_of(parsed), symbols).where(F.col("owner").isNotNull())
    details = owned.groupBy("service", "file", F.col("owner").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "detail"))), lambda x: x["detail"]).alias("infra"))
    functions = symbols.join(details, ["service", "file", "name"], "left").withColumn("infra", F.coalesce("infra", F.array().cast("array<string>")))
    own = functions.select(
        F.concat_ws("::", "service", "file", "name", F.concat(F.lit("L"), F.col("start_line").cast("string"))).alias("id"),
        S.function_chunk(F.col("language"), S.signature(F.col("name"), F.col("params"), F.col("return_type")), F.col("file"), F.col("start_line"), F.col("end_line"), F.transform("calls", lambda c: c["name"]), F.col("infra")).alias("document"),
        "service", "file", "language", "name", "start_line", "end_line", (F.size("infra") > 0).alias("has_infra"),
    )
    kinds = classes.select(
        F.concat_ws("::", "service", "file", F.lit("class"), "name", F.concat(F.lit("L"), F.col("start_line").cast("string"))).alias("id"),
        S.class_chunk(F.col("language"), F.col("name"), F.col("bases"), F.col("file"), F.col("start_line"), F.col("end_line"), F.col("methods"), F.col("docstring")).alias("document"),
        "service", "file", "language", "name", "start_line", "end_line", F.lit(False).alias("has_infra"),
    )
    shown = lambda head, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(head), F.col(c)))
    flows = parser.dags_of(parsed).withColumn("task_names", F.array_join(F.transform("tasks", lambda t: t["name"]), ", "))
    flow = flows.select(
        F.concat_ws("::", "service", "file", F.lit("dag"), "name").alias("id"),
        F.concat_ws("\n", F.concat(F.lit("[yaml] DAG: "), "name"), F.concat(F.lit("File: "), "file"), shown("Description: ", "description"), shown("Schedule: ", "schedule"), F.concat(F.lit("Tasks: "), "task_names")).alias("document"),
        "service", "file", F.lit("yaml").alias("language"), "name", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(False).alias("has_infra"),
    )
    short = F.element_at(F.split("operator", r"\."), -1)
    needs = F.when(F.size("dependencies") > 0, F.concat(F.lit("Dependencies: "), F.array_join("dependencies", ", ")))
    task = tasks.select(
        F.concat_ws("::", "service", "file", F.lit("task"), "dag", "name").alias("id"),
        F.concat_ws("\n", F.concat(F.lit("[yaml] Task: "), "name", F.lit(" ("), short, F.lit(")")), F.concat(F.lit("DAG: "), "dag"), F.concat(F.lit("File: "), "file"), F.concat(F.lit("Operator: "), "operator"), shown("Calls: ", "callable_name"), shown("Callable file: ", "callable_file"), shown("Bash command: ", "bash_command"), shown("SQL: ", "sql"), shown("Postgres connection: ", "conn_id"), needs, shown("Op kwargs: ", "op_kwargs")).alias("document"),
        "service", "file", F.lit("yaml").alias("language"), "name", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), (F.col("conn_id").isNotNull() | F.col("bash_command").isNotNull()).alias("has_infra"),
    )
    return own.unionByName(kinds).unionByName(flow).unionByName(task)
