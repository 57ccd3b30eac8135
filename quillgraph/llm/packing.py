"""Operator 2, best-fit packing: conflict-constrained best fit.

Documents are packed into sequences (bins) of ``CAPACITY`` words.  A document
longer than that is cut into full bins of its own and a remainder.  The pieces
left are placed in descending order of length: bins are kept in the order of
their residual space, each with a bitmap of the sources and one of the
duplicate clusters it holds; from the tightest bin that has room, the search
goes on to the next one until a bin is found that holds neither the piece's
source nor its cluster; without one, a new bin is opened.  So a sequence never
shows two documents of one source, nor two near copies of a document (groups
of ``near_copies``).

Pieces are dealt by a hash of their row into packing shards of about
``PIECES_EACH``; each shard is packed on its own, which costs a part of one
bin a shard.  Only (doc_id, source, cluster, words, text hash) move, no texts.

Defined cases: a document without words has one row with 0 words and no bin; a
null source or cluster is one value like any other; equal lengths are placed
in the order of doc_id (null first), cluster and piece; repeated rows are
numbered copies of one cluster, each with bins of its own for its full pieces;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import near_copies
from quillgraph.llm.frames import cut, read, workers_import
from quillgraph.llm.mixing import WORDS, word_count

CAPACITY = 2048
PIECES_EACH = 4000


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, for pieces in the order of placing; sources and clusters are numbers from 0."""
    residuals: list[tuple[int, int]] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        chosen = len(held_sources)
        space = capacity
        for at in range(bisect_left(residuals, (length, -1)), len(residuals)):
            residual, number = residuals[at]
            if not held_sources[number] & source_bit and not held_clusters[number] & cluster_bit:
                chosen, space = number, residual
                del residuals[at]
                break
        else:
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[chosen] |= source_bit
        held_clusters[chosen] |= cluster_bit
        bins.append(chosen)
        offsets.append(capacity - space)
        if space > length:
            insort(residuals, (space - length, chosen))
    return bins, offsets


def _packer(capacity: int):
    def pack_shard(table: pa.Table) -> pa.Table:
        keys = [("n_words", "descending"), *((c, "ascending") for c in ("doc_id", "cluster", "piece", "text_hash", "source", "copy"))]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        codes = [table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist() for c in ("source", "cluster")]
        bins, offsets = best_fit(table["n_words"].to_pylist(), *codes, capacity)
        kept = table.select(["doc_id", "piece", "start", "n_words", "text_hash", "shard"])
        return kept.append_column("bin", pa.array(bins, pa.int64())).append_column("bin_offset", pa.array(offsets, pa.int64()))

    return pack_shard


def pack(rows: DataFrame, capacity: int = CAPACITY, pieces_each: int = PIECES_EACH) -> DataFrame:
    """doc_id, piece, start, n_words, text_hash, shard, bin and bin_offset of each piece, from (doc_id, source, cluster, n_words, text_hash).

    Bins that a long document fills alone have the shard -1 and are numbered
    by the hash of its row, with a number for rows that repeat each other.
    """
    rows = cut(rows.select("doc_id", "source", "cluster", "n_words", "text_hash"))
    shards = max(1, -(-rows.count() // pieces_each))
    # Rows that repeat each other are counted and written out again with a number, so very many of them meet in no task.
    equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    pieces = equal.select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).withColumn("full", F.floor(F.col("n_words") / capacity)).withColumn("rest", F.col("n_words") % capacity)
    alone = pieces.where("full > 0").select("doc_id", "source", "text_hash", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    number = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "text_hash", "copy", "piece")
    alone = alone.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_words"), "text_hash", F.lit(-1).cast("long").alias("shard"), number.alias("bin"), F.lit(0).cast("long").alias("bin_offset"))
    rest = pieces.where("rest > 0").select("doc_id", "source", "cluster", "text_hash", "copy", F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("n_words"), F.pmod(F.xxhash64("doc_id", "cluster", "source", "copy"), F.lit(shards)).alias("shard"))
    workers_import(rows.sparkSession)
    packed = rest.groupBy("shard").applyInArrow(_packer(capacity), "doc_id long, piece long, start long, n_words long, text_hash long, shard long, bin long, bin_offset long")
    none = rows.where("n_words = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), "n_words", "text_hash", *(F.lit(None).cast("long").alias(c) for c in ("shard", "bin", "bin_offset")))
    return packed.unionByName(alone).unionByName(none)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, pieces_each: int = PIECES_EACH) -> DataFrame:
    """Packing of documents, near copies being a duplicate cluster and the length the number of words."""
    sized = documents.select("doc_id", "source", "text", word_count(F.col("text")).alias("n_words"))
    grouped = near_copies.groups(sized, "doc_id", "source", "n_words")
    return pack(grouped.select("doc_id", "source", F.col("root").alias("cluster"), "n_words", F.col("node").alias("text_hash")), capacity, pieces_each)


def sequences(documents: DataFrame, packed: DataFrame) -> DataFrame:
    """shard, bin, doc_ids and text of each sequence, pieces in the order of their offset and words joined by single spaces (documents by doc_id and text)."""
    key = F.struct("doc_id", "text_hash").alias("key")
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").select(key, "text").dropDuplicates(["key"])
    words = texts.select("key", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    pieces = packed.where("bin IS NOT NULL").withColumn("key", key).join(words, "key")
    cut_out = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    ordered = F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", cut_out.alias("text"))))
    return pieces.groupBy("shard", "bin").agg(ordered.alias("p")).select("shard", "bin", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.text", "\n").alias("text"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).drop("text_hash")
