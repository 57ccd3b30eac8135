"""Tables kept as batches of changes: what is written grows with the change, not with the table.

A batch holds the new rows of some keys and marks for keys that are gone, as
Parquet files by service.  It counts from when its name stands in the log, a
folder of empty files whose names are in order; a writer that dies before that
leaves nothing that is read.  A table is the newest row of each key (``newest``,
one partial aggregation), so batches of several writers add up without locks:
of two that write one key, the later name counts.  When ``FAN`` batches of a
tier have come together they are merged into one of the next tier, so a row is
rewritten about log(batches) times in all and a read meets few batches.

A merge keeps each row's place in the order (``_at``): while both the merged
batch and its sources stand in the log, or when two writers merge the same ones,
the rows are the same.  Marks of gone keys are dropped only by a merge of the
oldest batches.  Files of merged batches stay until the next merge, for readers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.lineage import cut

FAN = 8


def newest(changes: DataFrame, key: list[str], at: str = "_at", gone: str = "_gone") -> DataFrame:
    """The last row of each key, without keys whose last row is a mark; the columns of order and mark are dropped."""
    others = [c for c in changes.columns if c not in (*key, at, gone)]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(gone, *others), F.col(at)).alias("_row"))
    return last.where(~F.col(f"_row.{gone}")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in others))


class ChangeLog:
    """A Parquet table with keys, the first of which is the service; read, and changed by batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.types = dict(spark.createDataFrame([], schema).dtypes)
        self.columns = list(self.types)

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(), self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def entries(self) -> list[str]:
        """Names (number, batch and tier) of the batches that count, in order."""
        return self._names("log")

    def exists(self) -> bool:
        return bool(self.entries())

    def _batch(self, entry: str) -> str:
        return f"{self.path}/batches/batch={entry.split('-')[1]}"

    def changes(self, entries: list[str]) -> DataFrame:
        """All rows and marks of the batches, each with its place in the order."""
        schema = f"{self.schema}, _gone boolean, _at string, batch string"
        if not entries:
            return self.spark.createDataFrame([], schema).drop("batch")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/batches").parquet(*map(self._batch, entries))
        name = reduce(lambda rest, e: F.when(F.col("batch") == e.split("-")[1], e).otherwise(rest), entries, F.lit(None))
        return rows.withColumn("_at", F.coalesce("_at", name)).select(*self.columns, "_gone", "_at")

    def load(self) -> DataFrame:
        return newest(self.changes(self.entries()), self.key).select(*self.columns)

    def get(self, column: str, value: str) -> DataFrame:
        return self.load().where(F.col(column) == value)

    def apply(self, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """One batch: rows in place of those of equal keys (keys at most once), and keys (``gone``, winning over rows) without a row."""
        mark = lambda df, is_gone: df.select(*(F.col(c).cast(t).alias(c) for c, t in self.types.items()), F.lit(is_gone).alias("_gone"), F.lit(None).cast("string").alias("_at"))
        empty = self.spark.createDataFrame([], self.schema)
        batch = mark(empty if rows is None else rows, False)
        if gone is not None:
            keys = gone.select(*self.key).distinct()
            batch = batch.join(keys, self.key, "left_anti").select(*batch.columns).unionByName(mark(empty.unionByName(keys, allowMissingColumns=True), True))
        self._publish(batch, 0)
        self.merge()

    def _publish(self, batch: DataFrame, tier: int) -> None:
        name = uuid.uuid4().hex
        batch.write.partitionBy(self.key[0]).parquet(f"{self.path}/batches/batch={name}")
        entries = self.entries()
        number = int(entries[-1].split("-")[0]) + 1 if entries else 0
        self._fs().create(self._at("log", f"{number:012d}-{name}-{tier}"), False).close()

    def merge(self) -> None:
        """Merge each tier that has ``FAN`` batches into one of the next."""
        tier = 0
        while True:
            fs, entries = self._fs(), self.entries()
            full = [e for e in entries if int(e.split("-")[2]) == tier]
            if len(full) < FAN:
                return
            for old in self._names("merged"):
                fs.delete(self._at("batches", f"batch={old.split('-')[1]}"), True)
                fs.delete(self._at("merged", old), False)
            rows = self.changes(full)
            others = [c for c in rows.columns if c not in (*self.key, "_at")]
            last = rows.groupBy(*self.key).agg(F.max("_at").alias("_at"), F.max_by(F.struct(*others), "_at").alias("_row")).select(*self.key, *(F.col(f"_row.{c}").alias(c) for c in others), "_at")
            # A mark is needed as long as an older row of its key may lie in another batch; merged ones hold older rows than their names say.
            oldest = all(e in full or e > full[-1] and e.endswith("-0") for e in entries)
            self._publish((last.where("NOT _gone") if oldest else last).select(*self.columns, "_gone", "_at"), tier + 1)
            fs.mkdirs(self._at("merged"))
            for e in full:  # oldest first, so that no row outlives its mark
                fs.rename(self._at("log", e), self._at("merged", e))
            tier += 1


class MemoryChanges:
    """The same surface for tables that last as long as the session."""

    def __init__(self, spark: SparkSession, schema: str, key: list[str]):
        # Not a local table: the optimizer folds empty ones away, and a checkpoint of what is left can lack columns (Spark 4.1).
        self.spark, self.key, self.rows = spark, key, spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)

    def exists(self) -> bool:
        return True

    def load(self) -> DataFrame:
        return self.rows

    def get(self, column: str, value: str) -> DataFrame:
        return self.rows.where(F.col(column) == value)

    def apply(self, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        new = self.rows.limit(0) if rows is None else rows.select(*self.rows.columns)
        kept = self.rows.join(new.select(*self.key), self.key, "left_anti").select(*self.rows.columns).unionByName(new)
        self.rows = cut(kept if gone is None else kept.join(gone.select(*self.key).distinct(), self.key, "left_anti").select(*self.rows.columns))


# ---- histories


HISTORY = "service string, kind string, label string, id string, detail string, opened long, closed long"
FACT = ["service", "kind", "label", "id", "detail"]


def advance(history: DataFrame, facts: DataFrame, sequence: Column | int) -> DataFrame:
    """Rows of the history that a new state adds or replaces: facts that are gone are closed at ``sequence``, new ones opened.

    facts: distinct rows of ``FACT`` without nulls; the history's open rows are
    the state before.  What is the same in both gives no row.
    """
    at = sequence if isinstance(sequence, Column) else F.lit(sequence).cast("long")
    current = history.where("closed IS NULL")
    gone = current.join(facts, FACT, "left_anti").withColumn("closed", at)
    new = facts.join(current, FACT, "left_anti").select(*FACT, at.alias("opened"), F.lit(None).cast("long").alias("closed"))
    return gone.select(*FACT, "opened", "closed").unionByName(new)


def as_of(history: DataFrame, sequence: Column) -> DataFrame:
    """The state right after the sync of that number."""
    return history.where((F.col("opened") <= sequence) & (F.col("closed").isNull() | (F.col("closed") > sequence)))


def differences(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts of which a pair of syncs (service, before, after) has one side only, with ``change`` added or removed.

    The pairs are few, as they name syncs to compare, and broadcast, so a history
    isn't dealt by its service.  A fact that was closed and opened again in
    between is the same on both sides and cancels out.
    """
    net = _sides(history, pairs).groupBy("before", "after", *FACT).agg(F.sum("side").alias("side")).where("side <> 0")
    return net.withColumn("change", F.when(F.col("side") > 0, "added").otherwise("removed")).drop("side")


def _sides(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """The history's rows that hold on one side of a pair only, with 1 for the later and -1 for the earlier one."""
    at = lambda c: (F.col("opened") <= F.col(c)) & (F.col("closed").isNull() | (F.col("closed") > F.col(c)))
    return history.join(F.broadcast(pairs), "service").withColumn("side", at("after").cast("int") - at("before").cast("int")).where("side <> 0")


def history_count_differences(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """``count_differences`` of ``differences``, from the numbers of facts that were opened and closed at the same syncs: what cancels out in a fact does so in its sum."""
    spans = history.groupBy("service", "kind", "label", "opened", "closed").agg(F.count(F.lit(1)).alias("n"))
    return _sides(spans, pairs).groupBy("service", "before", "after", "kind", "label").agg(F.sum(F.col("side") * F.col("n")).alias("delta")).where("delta <> 0")


def count_differences(found: DataFrame) -> DataFrame:
    """Change of the number of facts of each kind and label between the syncs of each pair."""
    change = F.when(F.col("change") == "added", 1).otherwise(-1)
    return found.groupBy("service", "before", "after", "kind", "label").agg(F.sum(change).alias("delta")).where("delta <> 0")
