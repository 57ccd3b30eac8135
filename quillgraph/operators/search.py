"""Retrieval: keyword filter, vector top-k, rank fusion, usage boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scalar import keyword_document, rrf
from quillgraph.operators import indexes


#: Where a keyword is looked for, and what tells nodes apart in an index of them.
TEXTS, NODE = ["name", "file", "docstring"], ["label", "service", "file", "name"]


def keyword(nodes: DataFrame, pattern: str, top: int, postings: DataFrame | None = None) -> DataFrame:
    """Nodes (label, name, file, docstring, service) that contain the pattern in any text, the first ``top`` by id; with an index of their trigrams (by ``NODE``), only candidates are read."""
    needle = F.lower(F.lit(pattern))
    hit = F.contains(F.lower("name"), needle) | F.contains(F.lower("file"), needle) | F.contains(F.lower(F.coalesce("docstring", F.lit(""))), needle)
    held = nodes.where(hit) if postings is None else indexes.containing(nodes, postings, pattern, NODE, TEXTS)
    found = held.withColumn("id", F.concat_ws(":", "label", "file", "name"))
    return found.orderBy("id").limit(top).withColumn("document", keyword_document(F.col("label"), F.col("name"), F.col("file"), F.col("docstring")))


def keyword_core(nodes: DataFrame, pattern: str, top: int) -> DataFrame:
    """The same hits under the id service::file::name, with the whole docstring and the score 0."""
    text = F.col("docstring")
    found = keyword(nodes, pattern, top).select(F.concat_ws("::", "service", "file", "name").alias("id"), "label", "name", "file", "docstring", "service")
    document = F.concat_ws("\n", F.concat(F.lit("["), "label", F.lit("] "), "name"), F.concat(F.lit("File: "), "file"), F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("Doc: "), text)))
    return found.select("id", document.alias("document"), F.lit(0.0).alias("score"), F.lit("keyword").alias("source"))


def ranked(results: DataFrame, order: list[Column]) -> DataFrame:
    """Adds the 1-based rank; results are at most top-k rows."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector(chunks: DataFrame, query: list[float] | DataFrame, top: int, metric: str = "l2") -> DataFrame:
    """The nearest chunks with distance (ties by id), to a literal or to the vector (column point) of a table of one row; every task keeps only its top rows."""
    if isinstance(query, DataFrame):
        compared = chunks.crossJoin(F.broadcast(query.select(F.col("point").alias("_point"))))
    else:
        compared = chunks.withColumn("_point", F.array(*(F.lit(float(x)) for x in query)))
    distance = squared_distance(F.col("embedding"), F.col("_point")) if metric == "l2" else 1 - cosine(F.col("embedding"), F.col("_point"))
    return compared.withColumn("distance", F.round(distance, 6)).drop("_point").orderBy("distance", "id").limit(top)


def fuse(semantic: DataFrame, keywords: DataFrame, top: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank): id, score, source."""
    both = semantic.select("id", "rank", F.lit("semantic").alias("source")).unionByName(keywords.select("id", "rank", F.lit("keyword").alias("source")))
    source = F.when(F.count_distinct("source") == 2, "both").otherwise(F.min("source"))
    return both.groupBy("id").agg(F.sum(rrf(F.col("rank"))).alias("score"), source.alias("source")).orderBy(F.desc(F.round("score", 9)), "id").limit(top)


def boost(results: DataFrame, hits: DataFrame) -> DataFrame:
    """0.7 of the score and 0.3 of the hits, each over the largest, for at most top-k results (id, score)."""
    joined = results.join(hits.select("id", "hit_count"), "id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
    whole = Window.partitionBy()
    best = F.max("score").over(whole)
    normal = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    return joined.withColumn("boosted", normal * 0.7 + F.col("hit_count") / F.greatest(F.max("hit_count").over(whole), F.lit(1)) * 0.3)


def hybrid(nodes: DataFrame, pattern: str, chunks: DataFrame, query: list[float] | DataFrame, hits: DataFrame, top: int = 5, mode: str = "hybrid", vectors: indexes.VectorIndex | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Search in one of three modes; a pure function of its tables, so looking something up changes nothing.

    With indexes of the chunks' vectors and of the nodes' trigrams, these are
    read in place of all chunks and nodes (the query then is a table).
    """
    if mode == "keyword":
        return ranked(keyword(nodes, pattern, top, postings).select("id"), [F.col("id")]).select("id", rrf(F.col("rank")).alias("score"), F.lit("keyword").alias("source"))
    near = vector(chunks, query, top) if vectors is None else indexes.search_vectors(vectors, query.select(F.lit(0).alias("query"), "point"), top)
    if mode == "semantic":
        scored = near.select("id", (1 - F.col("distance")).alias("score"))
        return boost(scored, hits).select("id", F.col("boosted").alias("score"), F.lit("semantic").alias("source"))
    fused = fuse(ranked(near, [F.col("distance"), F.col("id")]), ranked(keyword(nodes, pattern, top, postings), [F.col("id")]), top)
    return boost(fused, hits).select("id", F.col("boosted").alias("score"), "source")


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic embedding for texts without a model: signed counts of hashed words, over their length."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).alias("i"), (F.pmod(F.shiftright(F.xxhash64(w), 32), F.lit(2)) * 2 - 1).cast("double").alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(slots, lambda x: x["i"] == k), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def match_symbols(nodes: DataFrame, pattern: str, service: str | None, limit: int) -> DataFrame:
    rows = nodes.where(F.contains("name", F.lit(pattern)) & F.col("label").isin("Function", "Class", "Method"))
    rows = rows if service is None else rows.where(F.col("service") == service)
    return rows.orderBy("name", "file", "service").limit(limit)
