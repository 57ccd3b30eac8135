"""Code-knowledge views over the driver's tables, derived alike here and in the SQL of ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.scalar import normalize_path


class Views:
    """Tables of one folder, read by Spark only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def functions(self) -> DataFrame:
        """Function nodes: parts."""
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("file"), F.col("p_brand").alias("service"), F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"))

    def sites(self) -> DataFrame:
        """CALLS with confidence and multiplicity: a returned part to the order's next returned one."""
        window = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        line = self.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(window).alias("dst"), "l_discount")
        confidence = F.when(F.col("l_discount") < 0.04, 0.95).when(F.col("l_discount") < 0.08, 0.85).otherwise(0.7)
        return line.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.max(confidence).alias("confidence"), F.count(F.lit(1)).alias("sites"))

    def calls(self) -> DataFrame:
        return self.sites().drop("sites")

    def service_calls(self) -> DataFrame:
        own = self.functions().select(F.col("id").alias("src"), "service")
        other = self.functions().select(F.col("id").alias("dst"), F.col("service").alias("s2"))
        return self.calls().join(own, "src").join(other, "dst").where("service = s2").drop("s2")

    def resources(self) -> DataFrame:
        """Resource edges (src, type, dst): parts to suppliers of lines of status F, by the supplier's number."""
        line = self.table("lineitem").where("l_linestatus = 'F'")
        kind = F.when(F.col("l_suppkey") % 3 == 0, "CONNECTS_TO").when(F.col("l_suppkey") % 3 == 1, "PRODUCES_TO").otherwise("CONSUMES_FROM")
        return line.select(F.col("l_partkey").alias("src"), kind.alias("type"), F.col("l_suppkey").alias("dst")).distinct()

    def produced(self) -> DataFrame:
        """Supplier to topic (part) of shipped lines."""
        return self.table("lineitem").where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hub"))

    def consumed(self) -> DataFrame:
        return self.table("lineitem").where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("hub"))

    def routes(self) -> DataFrame:
        """Routes: each page's path or a template of it, by a handler in one of three services."""
        pages = self.table("pages")
        path = normalize_path(F.col("url"))
        template = F.concat(F.regexp_extract(path, "^(/[^/]*)", 1), F.lit("/{id}"))
        return pages.select(F.col("page_id").alias("handler"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("service"), F.when(F.col("page_id") % 2 == 0, path).otherwise(template).alias("route"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"))

    def callers(self) -> DataFrame:
        return self.table("pages").select(F.col("page_id").alias("caller"), F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("service"), "url")

    def chunks(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    def keyword_nodes(self) -> DataFrame:
        return self.table("documents").select(F.when(F.col("doc_id") % 3 == 0, "Class").otherwise("Function").alias("label"), F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("file"), F.col("text").alias("docstring"), F.col("source").alias("service"))

    def events(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", "user_id", F.col("event_type").alias("query"), (F.col("user_id") % 500).alias("top_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("top_score"))

    def snapshot_routes(self, late: bool) -> DataFrame:
        """Routes before 1997 or from 1999 on: priority and customer of an order as the path, its status as the method."""
        rows = self.table("orders").where("o_orderdate >= TIMESTAMP '1999-01-01'" if late else "o_orderdate < TIMESTAMP '1997-01-01'")
        return rows.select(F.concat(F.lit("/"), F.col("o_orderpriority"), F.lit("/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("method")).distinct()

    def ledger(self) -> DataFrame:
        text = F.col("text")
        role = lambda r: F.when(F.col("role") == r, F.array(text))
        single = F.when(F.col("role") == "user", text)
        return self.table("conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("seq"), single.alias("objective"), F.col("role").alias("state"), role("user").alias("constraints"), role("assistant").alias("decisions"), F.array("role").alias("files"), role("assistant").alias("commands"), role("system").alias("questions"), role("user").alias("next"))

    def artifacts(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ("test_log", "diff", "terminal_output", "document"))), (F.col("doc_id") % 4 + 1).cast("int"))
        return self.table("documents").select(F.col("doc_id").alias("id"), kind.alias("kind"), F.col("text").alias("content"))

    def stamped(self) -> DataFrame:
        """Nodes with the common fields, some missing: customers."""
        c = self.table("customer")
        return c.select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 != 0, F.when(F.col("c_custkey") % 13 == 0, "0.9").otherwise("1.0")).alias("schema_version"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("first_seen"), F.col("c_custkey").alias("last_seen"), F.when(F.col("c_acctbal") > 0, "scan").alias("source"))
