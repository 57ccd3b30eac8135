"""Small documents with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, text_hash string, row int, size string, shard string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, repeated rows, ties, non-ASCII text."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 4, 5, 60, 80, 120, 400)]
    long = "\n".join(words(rng, 12) for _ in range(2500))
    passage = words(rng, 120)
    texts = [None, "", " \t\n", *base, base[5], base[5] + " x", long, long, "é" * 3, "ñandú über straße " * 30, passage + "\n" + base[3], base[4] + "\n" + passage, "a" * 1200, "spam line\n" * 40 + base[3]]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t) if t is not None else None, "h", "t", i, "z", None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base[3], "en", "s1", 5, None, None, None, None, None), (None, base[3], "en", "s1", 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(100 + i, words(rng, 70), "en", "s0", 1, None, None, None, None, None) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
