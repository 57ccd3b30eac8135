"""Operator 8, mixing sources to target weights: Sainte-Laguë apportionment.

Sources, in order of code points with null last, weigh 5, 2, 1, repeating.
Together they are to give ``SHARE`` times all words; no source gives more than
twice its own words, and what that cuts off is dealt to the others by weight
until none is above.  The words are handed out in equal blocks of words: seats
go to sources by the highest quotients target / (2 k + 1), and a source's
seats go in the same way to the groups of its shards and from there to its
shards by their words, so every shard has an integer quota.  What a part can't
take, as it would be above ``MOST`` times its words, and what is less than a
block goes to the next ones in order that can; so a source gives its seats'
words exactly.  A shard's documents stand in a seeded order; its quota is met
by whole passes over the shard and then by its first words in that order, so
one document of a shard at most is taken in part.

There are ``BLOCKS`` blocks, or more where a shard would else have less than
``SHARD_BLOCKS`` of them.  A source is split by a hash of its rows into shards
of about ``SHARD_WORDS`` words, and these into groups of ``GROUP_SHARDS``, so a
source that holds a third of all rows is no larger task than any other.  Main
path: DataFrame functions only.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own; a source without words has the target 0; repeated rows are
documents of their own (equal ones in any order, as they are
interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.frames import cut, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCKS = 1_000_000
SHARD_WORDS = 1_000_000
SHARD_BLOCKS = 64
GROUP_SHARDS = 1024
SEED = 11
#: Words of a text.
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows (source, source_size and any others), one a source, with their target.

    A source is at its limit once the level (words a unit of weight) reaches
    limit / weight, so with sources in the order of that ratio the level is
    what is left beyond the limits below it, over the weights not below it;
    that rises up to the first source that isn't at its limit and falls after
    it, so the common level is the highest.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sized = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    wanted = F.sum("source_size").over(whole) * float(share)
    left = wanted - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = sized.withColumn("level", level).withColumn("common", F.max("level").over(whole))
    return levelled.select(*sources.columns, F.least(F.col("limit"), F.col("common") * F.col("weight")).alias("target"))


def sainte_lague(parts: DataFrame, seats: Column, votes: str, within: list[str], order: list[str], out: str) -> DataFrame:
    """Seats of each part by highest quotients votes / (2 k + 1), among the parts with equal ``within``; ties by ``order``.

    A divisor that is surely not too low hands out most seats at once; at most
    as many seats as there are parts are left for the next quotients, of which
    three a part are made on average.
    """
    group = Window.partitionBy(*within)
    counted = parts.withColumn("_seats", seats.cast("long")).withColumn("_votes", F.greatest(F.sum(votes).over(group).cast("double"), F.lit(1e-300))).withColumn("_n", F.count(F.lit(1)).over(group))
    many = F.col("_seats") > F.col("_n")
    sure = F.when(many, F.floor(F.col(votes) / F.col("_votes") * (F.col("_seats") - F.col("_n") / 2) + 0.5)).otherwise(0).cast("long")
    counted = counted.withColumn("_sure", sure).withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    ahead = F.ceil(F.col(votes) / F.col("_votes") * F.when(many, F.col("_n")).otherwise(F.col("_seats") + F.col("_n") / 2)) + 2
    ahead = F.when(F.col(votes) > 0, F.least("_open", ahead.cast("long"))).otherwise(0)
    columns = counted.columns
    nexts = counted.select("*", F.explode_outer(F.when(ahead > 0, F.sequence(F.lit(0).cast("long"), ahead - 1))).alias("_k"))
    nexts = nexts.withColumn("_q", F.col(votes) / (2 * (F.col("_sure") + F.col("_k")) + 1))
    ranked = nexts.withColumn("_place", F.row_number().over(group.orderBy(F.desc_nulls_last("_q"), *(F.asc_nulls_last(c) for c in order))))
    won = ranked.groupBy(*columns).agg(F.count_if(F.col("_k").isNotNull() & (F.col("_place") <= F.col("_open"))).alias("_won"))
    return won.withColumn(out, F.col("_sure") + F.col("_won")).select(*parts.columns, out)


def deal(parts: DataFrame, words: str, size: str, most: int, within: list[str], order: list[str], out: str) -> DataFrame:
    """Words of each part, which sum up to ``words`` (not above ``most`` times the sizes' sum) among the parts with equal ``within``.

    Blocks (column block) go by highest quotients; what a part can't take and
    the words below a block go to the first parts in ``order`` with space.
    """
    group = Window.partitionBy(*within)
    quotas = sainte_lague(parts, F.floor(F.col(words) / F.col("block")), size, within, order, "_quota")
    quotas = quotas.withColumn("_own", F.least(F.col("_quota") * F.col("block"), F.col(size) * most)).withColumn("_spare", F.col(size) * most - F.col("_own"))
    before = group.orderBy(*(F.asc_nulls_last(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(words) - F.sum("_own").over(group) - F.coalesce(F.sum("_spare").over(before), F.lit(0))
    more = F.greatest(F.lit(0), F.least("_spare", left))
    return quotas.withColumn(out, (F.col("_own") + more).cast("long")).select(*parts.columns, out)


def mix(documents: DataFrame, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS, shard_words: int = SHARD_WORDS, group_shards: int = GROUP_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target and taken of each document."""
    rows = cut(documents.select("doc_id", "source", F.md5("text").alias("text_hash"), word_count(F.col("text")).alias("size")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goal = targets(sources, share, most)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    block = F.greatest(F.lit(1), F.least(F.ceil(total / blocks), F.lit(max(1, shard_words // SHARD_BLOCKS))))
    goal = goal.withColumn("block", block.cast("long")).withColumn("seats", F.round(total / F.col("block")))
    quotas = sainte_lague(goal, F.col("seats"), "target", [], ["source"], "quota")
    # A row counts beside its words, so rows without words are split up too.
    n_shards = F.ceil((F.col("source_size") + F.col("n_rows")) / shard_words)
    quotas = quotas.withColumn("source_words", F.least(F.col("quota") * F.col("block"), F.col("source_size") * most)).withColumn("n_shards", n_shards)
    quotas = cut(quotas.select(F.col("source").alias("s"), "source_size", "target", "block", "source_words", "n_shards", F.ceil(n_shards / group_shards).alias("n_groups")))
    # The seeded order is a digest, so reruns and other engines agree.
    draw = F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), "text_hash"))
    placed = rows.join(quotas, F.col("source").eqNullSafe(F.col("s"))).withColumn("draw", draw)
    placed = placed.withColumn("shard", F.conv(F.substring("draw", 1, 12), 16, 10).cast("long") % F.col("n_shards"))
    sums = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), *(F.first(c).alias(c) for c in ("block", "source_words", "n_groups")))
    shards = cut(sums.withColumn("group", F.col("shard") % F.col("n_groups")))
    groups = shards.groupBy("source", "group").agg(F.sum("shard_size").alias("group_size"), F.first("block").alias("block"), F.first("source_words").alias("source_words"))
    groups = deal(groups, "source_words", "group_size", most, ["source"], ["group"], "group_words").select(F.col("source").alias("s1"), F.col("group").alias("g1"), "group_words")
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("s1")) & (F.col("group") == F.col("g1"))).select("source", "group", "shard", "shard_size", "block", "group_words")
    shards = deal(shards, "group_words", "shard_size", most, ["source", "group"], ["shard"], "wanted")
    shards = shards.select(F.col("source").alias("s2"), F.col("shard").alias("h2"), "shard_size", "wanted")
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2")))
    whole = F.greatest("shard_size", F.lit(1))
    placed = placed.withColumn("passes", F.floor(F.col("wanted") / whole)).withColumn("rest", F.col("wanted") % whole)
    before = Window.partitionBy("source", "shard").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("size").over(before), F.lit(0))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - begun))
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(documents: DataFrame, **options: float) -> DataFrame:
    """The documents as the mix takes them (columns of documents): a row for each whole pass, and one with the first words for a part.

    A part's words are joined by single spaces.  What equal rows give together
    is dealt evenly among them.
    """
    row = F.struct("doc_id", "text_hash", "source").alias("row")
    chosen = mix(documents, **options).groupBy(row).agg(F.sum("taken").alias("total"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("total > 0")
    joined = documents.withColumn("text_hash", F.md5("text")).select("doc_id", "text", "lang", "source", row).join(chosen, "row")
    k = F.row_number().over(Window.partitionBy("row").orderBy("lang"))
    dealt = joined.withColumn("k", k).withColumn("taken", F.floor(F.col("k") * F.col("total") / F.col("n")) - F.floor((F.col("k") - 1) * F.col("total") / F.col("n")))
    copies = F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    part = F.col("taken") % F.col("size")
    copies = F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)
    rows = dealt.select("doc_id", "text", "lang", "source", "size", F.explode(copies).alias("words"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    out = rows.withColumn("text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def op8_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")
