"""Rewriting a layout whose number of shards falls or rises, in place; parts of shards; given capacities."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import resharding

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def test_emptied_shards_lose_their_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (10 + i), "en", "s", 0) for i in range(60)], PLAIN)
    placed = resharding.reshard(df, 10).cache()
    stored = df.join(resharding.keyed(df).select("doc_id", "old_shard"), "doc_id")
    path = str(tmp_path / "layout")
    stored.withColumn("shard", F.col("old_shard")).drop("old_shard").write.partitionBy("shard").parquet(path)
    resharding.rewrite(stored, placed, path)
    back = Counter((r.doc_id, r.shard) for r in spark.read.parquet(path).collect())
    assert back == Counter((r.doc_id, r.shard) for r in placed.collect())


@pytest.mark.parametrize("new_shards", [3, 10, 32, 45])
def test_in_place_rewrite_keeps_every_row(spark, tmp_path, new_shards):
    rows = [(i % 50 if i % 7 else None, "x" * (10 + i % 40), "en", "s", 0) for i in range(200)]
    df = spark.createDataFrame(rows, PLAIN)
    path = str(tmp_path / "layout")
    keyed = resharding.keyed(df)
    df.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(resharding.OLD_SHARDS)).cast("int")).write.partitionBy("shard").parquet(path)
    placed = resharding.plan(keyed, new_shards).cache()
    placed.count()
    resharding.rewrite(spark.read.parquet(path).withColumnRenamed("shard", "old_shard"), placed, path)
    back = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in rows)
    assert Counter(r.shard for r in back) == Counter(r.shard for r in placed.collect())
    assert max(r.shard for r in back) < new_shards


def test_parts_of_shards_change_the_order_only(spark):
    keyed = resharding.keyed(spark.createDataFrame([(i, "x" * (i % 90), "en", "s", 0) for i in range(3000)], PLAIN)).cache()
    sizes = {}
    for part_rows in (3, 100_000):
        placed = resharding.slots(resharding.plan(keyed, 40, part_rows=part_rows), part_rows).collect()
        assert len(placed) == 3000
        held = {}
        for r in placed:
            held.setdefault(r.shard, []).append((r.slot, r["size"]))
        assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in held.values())
        sizes[part_rows] = [sum(n for _, n in held[k]) for k in range(40)]
    assert all(max(x) - min(x) < 250 for x in sizes.values())


def test_given_capacities_hold(spark):
    keyed = resharding.keyed(spark.createDataFrame([(i, "x" * 84, "en", "s", 0) for i in range(400)], PLAIN))
    capacities = [10_000, 0, 20_000, 10_100]
    held = Counter(r.shard for r in resharding.plan(keyed, 4, capacities).collect())
    assert held[1] == 0 and all(100 * held[k] <= c + 100 for k, c in enumerate(capacities)) and sum(held.values()) == 400
    with pytest.raises(ValueError):
        resharding.plan(keyed, 4, [100, 100, 100, 100])
