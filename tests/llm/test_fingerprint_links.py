"""The pipeline's near-dedup takes operator 7's links, checked, ahead of the bands."""

import random

from pyspark.sql import functions as F

from quillgraph.llm import near_copies, simhash


def test_links_of_fingerprints_are_taken_and_checked(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=300)
    texts = [" ".join(base), " ".join([*base[:150], "other", *base[151:]]), " ".join(rng.choices(words, k=300)), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    node = {r.doc_id: r.node for r in docs.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    asked = []
    plain = simhash.links

    def all_to_first(prints):
        """Operator 7's links, and one between texts that have nothing in common."""
        asked.append(1)
        far = {r.text_hash: r.fp for r in prints.collect()}
        return plain(prints).unionByName(spark.createDataFrame([(far[node[2]], far[node[0]]), (far[node[1]], far[node[0]])], "a long, b long"))

    monkeypatch.setattr(simhash, "links", all_to_first)
    linked = {frozenset(r) for r in near_copies.fingerprint_links(docs).collect()}
    assert frozenset((node[0], node[1])) in linked and all(node[2] not in pair for pair in linked)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {0, 2, 3}
    assert len(asked) == 2
