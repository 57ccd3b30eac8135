"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

The pipeline's near-dedup (``keep_one``) first takes the links of operator 7, texts
whose SimHash fingerprints differ in four bits at most, and keeps those that pass
the check on whole shingle sets.  A pair of similarity 0.8 differs in about ten of
64 bits, and tries that allow so many prune nothing, so this finds the nearer
copies; what it leaves apart goes on to the bands.  Texts are dealt to buckets by ``BANDS`` bands of ``BAND_HASHES`` least hashes each;
a pair of similarity s shares a bucket with the probability
``1 - (1 - s**BAND_HASHES)**BANDS``, which is 0.9999 at 0.8 and nearer to 1
above.  Pairs of a bucket are only candidates: each link is checked on the
whole shingle sets of both texts.

Links are found in two steps.  First each text is checked against the one text,
of those that lead its buckets of the first ``LEAD_BANDS`` bands, whose
signature is most like its own: one pair a text, which joins most of a large
group.  Then the buckets that still hold texts of several groups are looked
through: their texts' shingle sets meet in a task, which counts the shared
shingles of each text with all others of the bucket and keeps a forest of the
links.  A bucket of more than ``BLOCK_ROWS`` texts is dealt out as pairs of
blocks.  So the groups are those of all pairs of a bucket that pass, no row is
made for a pair that fails, and a task holds two blocks at most.  A group is
what such links join, step by step.

Equal texts are one node, named by the hash of the text.  Defined cases: null
and empty texts have no shingle and are near copies of each other only; fewer
than five words make one shingle of all of them; A-Z count as a-z; a null
doc_id is last in order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import simhash
from quillgraph.llm.frames import arrow_map, components, cut, partitions_for, whole_partition
from quillgraph.llm.scaled_sketch import resemblance, sketches

SHINGLE = 5
LEAST = 0.8
BANDS = 32
BAND_HASHES = 6
#: Bands whose buckets' first texts are tried ahead of the others.
LEAD_BANDS = 8
#: Equal bytes of two signatures from which on a pair is tried ahead; a pair of similarity 0.8 has 154 of 192 in the mean, with a deviation of 5.5.
LEAST_EQUAL = 128
#: Texts of a bucket that a task compares with as many others.
BLOCK_ROWS = 1000
#: Nodes (8 bytes each) up to which a table of them is broadcast.
BROADCAST_NODES = 1_000_000
SEED = 7
ROWS_EACH = 256


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles."""
    return sketches(pc.ascii_lower(texts), SHINGLE, 1)


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * BAND_HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bytes for each set, of the shingle that is least under each of the hashes; equal sets have equal rows."""
    filled = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    first = np.cumsum([0, *map(len, filled[:-1])])
    short = (np.concatenate(filled) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), len(_FACTORS)), np.uint8)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = (np.minimum.reduceat(short * factor, first) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def bucket_keys(signs: np.ndarray) -> np.ndarray:
    """Key of each band of each signature: the band's bytes below its number."""
    octets = np.zeros((len(signs), BANDS, 8), np.uint8)
    octets[:, :, 1] = np.arange(BANDS)
    octets[:, :, 2:] = signs.reshape(len(signs), BANDS, BAND_HASHES)
    return octets.view(">i8").reshape(len(signs), BANDS).astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * BAND_HASHES)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_EACH):
            part = batch.slice(low, ROWS_EACH)
            signs = pa.array([x.tobytes() for x in signatures(shingle_sets(part.column("text")))], pa.binary())
            kept = [k for k in part.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), signs], [*kept, "sign"])


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = bucket_keys(matrix(batch.column("sign")))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(keys.ravel())], ["node", "key"])


def _alike_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = (matrix(batch.column("a_sign")) == matrix(batch.column("b_sign"))).sum(1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int32())], ["a", "b", "same"])


def near_links(sets: list[np.ndarray], root: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (a forest, as places) that join those of the sets that are near copies and have different roots."""
    size = np.array([len(s) for s in sets])
    vocabulary, held = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.r_[0, np.cumsum(size)]
    of = np.repeat(np.arange(len(sets)), size)
    label = np.unique(root, return_inverse=True)[1]
    marked = np.zeros(len(vocabulary), bool)
    one, other = [], []
    # The sets of the commonest root are only met by the others.
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        if size[i]:
            own = held[first[i] : first[i + 1]]
            marked[own] = True
            shared = np.bincount(of[marked[held]], minlength=len(sets))
            marked[own] = False
            near = shared >= LEAST * (size[i] + size - shared)
        else:
            near = size == 0
        for j in np.flatnonzero(near & (label != label[i])).tolist():
            if label[j] != label[i]:
                one.append(i)
                other.append(j)
                label[label == label[j]] = label[i]
    return one, other


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_EACH):
            part = batch.slice(low, ROWS_EACH)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"))], pa.binary())], ["node", "shingles"])


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, one, other), a pair of blocks of a bucket; its sets are held until the next one begins."""
    columns = ("key", "one", "other", "node", "root", "shingles")
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if len({h[4] for h in held}) > 1:
            node = np.array([h[3] for h in held])
            a, b = near_links([np.frombuffer(h[5], np.uint64) for h in held], np.array([h[4] for h in held]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])
        held.clear()

    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_EACH):
            part = batch.slice(low, ROWS_EACH)
            for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from flush()
                held.append(row)
    yield from flush()


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other often have one text in common, which is then taken apart once."""
    held: tuple[int, np.ndarray] | None = None
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in ("a", "b"))
        ok = np.zeros(len(a), bool)
        for low in range(0, len(a), ROWS_EACH):
            part = batch.slice(low, ROWS_EACH)
            others = shingle_sets(part.column("a_text"))
            for i, other in enumerate(others, low):
                if held is None or held[0] != b[i]:
                    held = (int(b[i]), shingle_sets(batch.column("b_text").slice(i, 1))[0])
                ok[i] = resemblance(other, held[1]) >= LEAST
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _texts(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes, one row each.

    Few nodes are broadcast, after they were counted, so only the texts wanted
    move; beyond ``BROADCAST_NODES`` the distinct texts are joined by a shuffle.
    """
    wanted = cut(nodes.distinct())
    rows = documents.select(F.xxhash64("text").alias("node"), "text")
    if wanted.count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(wanted), "node", "left_semi").dropDuplicates(["node"])
    return rows.dropDuplicates(["node"]).join(wanted, "node", "left_semi")


def _checked(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of text hashes whose texts are near copies."""
    pairs = cut(pairs)
    texts = _texts(documents, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return cut(arrow_map(both.select("a", "b", "a_text", "b_text"), _check_batches, "a long, b long"))


def _unsettled(members: DataFrame, linked: DataFrame, block_rows: int) -> DataFrame:
    """(key, one, other, node, root): the buckets with several groups, in pairs of blocks."""
    rooted = members.join(components(linked), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in range(2)]
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), *same).where("low <> high")
    # Of buckets with the same texts one is looked through.
    once = mixed.groupBy("n", "same0", "same1").agg(F.min("key").alias("key"))
    blocks = once.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    apart = rooted.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = apart.select("key", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    return each.select("key", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "node", "root")


def fingerprint_links(documents: DataFrame) -> DataFrame:
    """Checked links (a, b) of text hashes from operator 7's: one text of each fingerprint stands for it, others of the fingerprint are held against that one."""
    prints = cut(simhash.fingerprints(documents).select("text_hash", "fp").distinct())
    first = cut(prints.groupBy("fp").agg(F.min("text_hash").alias("node")))
    equal = prints.join(first, "fp").where("text_hash <> node").select(F.col("text_hash").alias("a"), F.col("node").alias("b"))
    one, other = (first.select(F.col("fp").alias(n), F.col("node").alias(f"{n}_node")) for n in ("a", "b"))
    near = simhash.links(prints).join(one, "a").join(other, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return _checked(equal.unionByName(near).distinct(), documents)


def links(nodes: DataFrame, documents: DataFrame, block_rows: int = BLOCK_ROWS, known: DataFrame | None = None) -> DataFrame:
    """Checked links (a, b) that join exactly the near copies that share a bucket or are joined by known links, from (node, sign)."""
    placed = arrow_map(nodes.select("node", "sign"), _place_batches, "node long, key long")
    several = placed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    members = cut(placed.join(several, "key").select("key", "node", "first"))
    one, other = (nodes.select(F.col("node").alias(n), F.col("sign").alias(f"{n}_sign")) for n in ("a", "b"))
    # The band's number is in the second byte of the key.
    led = members.where((F.shiftrightunsigned("key", 48) < LEAD_BANDS) & (F.col("node") != F.col("first")))
    stars = led.select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    alike = arrow_map(stars.join(one, "a").join(other, "b").select("a", "b", "a_sign", "b_sign"), _alike_batches, "a long, b long, same int")
    linked = _checked(alike.where(F.col("same") >= LEAST_EQUAL).groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b")), documents)
    linked = linked if known is None else linked.unionByName(known)
    apart = cut(_unsettled(members, linked, block_rows))
    texts = _texts(documents, apart.select("node"))
    sets = arrow_map(texts, _set_batches, "node long, shingles binary")
    parts = partitions_for(nodes.sparkSession, apart.count(), 5000)
    met = apart.join(sets, "node").repartition(parts, "key", "one", "other").sortWithinPartitions("key", "one", "other")
    return linked.unionByName(cut(arrow_map(met.select("key", "one", "other", "node", "root", "shingles"), _bucket_batches, "a long, b long").distinct()))


def groups(documents: DataFrame, *columns: str, block_rows: int = BLOCK_ROWS, by_fingerprint: bool = False) -> DataFrame:
    """node (hash of the text), root (node that names the group) and the named columns of each document; links of fingerprints first, if asked."""
    rows = documents.select(*columns, F.xxhash64("text").alias("node"), "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    signed = cut(arrow_map(rows, _sign_batches, kinds + ", sign binary"))
    known = fingerprint_links(documents) if by_fingerprint else None
    root = components(links(cut(signed.groupBy("node").agg(F.first("sign").alias("sign"))), documents, block_rows, known))
    return signed.drop("sign").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group (columns of documents): that with the smallest doc_id, and of repeated rows one."""
    first = groups(documents, "doc_id", by_fingerprint=True).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("f"))
    chosen = first.select(F.struct("f.doc_id", F.col("f.node").alias("text_hash")).alias("row"))
    keyed = documents.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    return keyed.join(chosen, "row", "left_semi").dropDuplicates(["row"]).select("doc_id", "text", "lang", "source", "n_chars")
