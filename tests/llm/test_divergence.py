"""Operator 13 against plain counting, and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillgraph.llm import divergence, sql


def brute(rows, least, top):
    docs = [(r[0], re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)})), r[2] or "", r[3] or "") for r in rows]
    df, count, example = defaultdict(Counter), defaultdict(Counter), {}
    for doc, terms, lang, source in docs:
        df[lang].update(set(terms))
        count[lang, source].update(terms)
        count[lang, None].update(terms)
        for t in terms:
            if doc is not None:
                example[lang, source, t] = min(doc, example.get((lang, source, t), doc))
    groups = sorted({(lang, source) for _, _, lang, source in docs})
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        share = {}
        for source in [s for la, s in groups if la == lang] + [None]:
            total = sum(count[lang, source][t] for t in kept)
            share[source] = [1 + 10**9 * (count[lang, source][t] + 2) // (total + 2 * len(kept)) for t in kept]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source in [s for la, s in groups if la == lang]:
            pairs = [(sum(map(f, share[source], share[o])), o, None) for la, o in groups if la == lang and o != source]
            terms = [(f(p, q), t, example.get((lang, source, t))) for p, q, t in zip(share[source], share[None], kept) if count[lang, source][t] and p > q]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item, doc) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, source, part, item, value, rank, doc))
    return sorted(map(repr, out))


def made_up(n, seed=4):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "ÉPSILON", "zeta", "eta", "漢字", "x", "rare"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "c", None, ""])
        words = rng.choices(vocabulary, [300 // (k + 1) + 1 for k in range(len(vocabulary))], k=rng.choice([0, 3, 30, 200]))
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "1", "-", "\n"]).join(words) if i % 17 else None, rng.choice(["en", "en", "fr", None]), source, 0, *[None] * 5))
    return rows + [(5000, "lone words here", "xx", "only", 0, *[None] * 5)]


@pytest.mark.parametrize("least", [1, 3, 10])
def test_against_plain_counting(spark, docs, rows, least):
    made = made_up(300)
    df = spark.createDataFrame(made, docs.schema).repartition(5)
    assert sorted(repr(tuple(r)) for r in divergence.audit(df, least, 4).collect()) == brute(made, least, 4)
    assert sorted(repr(tuple(r)) for r in divergence.audit(docs, least).collect()) == brute(rows, least, 10)


def test_small_stretches(spark, docs, monkeypatch):
    made = made_up(120, 9)
    df = spark.createDataFrame(made, docs.schema).coalesce(1)
    rows = df.selectExpr("doc_id", "coalesce(text, '') text", "coalesce(lang, '') lang", "coalesce(source, '') source").toArrow().to_batches(max_chunksize=7)
    whole = sum(sum(b["n"].to_pylist()) for b in divergence._count(iter(rows)))
    monkeypatch.setattr(divergence, "STRETCH", 100)
    parts = list(divergence._count(iter(rows)))
    assert len(parts) > 5 and sum(sum(b["n"].to_pylist()) for b in parts) == whole


def test_partials_that_are_sent_early(monkeypatch):
    """Few sides and few held terms give the same sums and the same foremost terms."""
    rng = np.random.default_rng(5)
    runs = []
    for k in range(60):
        sources = sorted(rng.choice(list("abcdefghijklm"), rng.integers(1, 13), replace=False).tolist())
        p, p0, q = (rng.integers(1, 10**9, len(sources)) for _ in range(3))
        runs.append((("en", "de")[k % 2], f"t{k}", sources, [1] * len(sources), p, p0, q))

    def gathered():
        partials, out = divergence.Partials(3), []
        for run in runs:
            out += partials.add(*run)
        out.append(partials.emit())
        pairs, terms = Counter(), defaultdict(list)
        for r in (r for b in out for r in b.to_pylist()):
            if r["part"] == "pair":
                pairs[r["lang"], r["source"], r["item"]] += r["value"]
            else:
                terms[r["lang"], r["source"]].append((-r["value"], r["item"]))
        return len(out), pairs, {k: sorted(v)[:3] for k, v in terms.items()}

    whole = gathered()
    monkeypatch.setattr(divergence, "SIDES", 6)
    monkeypatch.setattr(divergence, "HELD", 4)
    parts = gathered()
    assert whole[0] == 1 < parts[0] and whole[1:] == parts[1:]
    plain = Counter()
    for lang, _, sources, _, p, p0, _ in runs:
        f = lambda x, y: (int(x) - int(y)) ** 2 // (int(x) + int(y))
        for a in range(len(sources)):
            for b in range(len(sources)):
                if a != b:
                    plain[lang, sources[a], sources[b]] += f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
    assert {k: v for k, v in plain.items() if v} == {k: v for k, v in whole[1].items() if v}


def test_sql_agrees(docs, rows, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(repr(tuple(r)) for r in con.execute(sql.op13()).fetchall()) == brute(rows, 10, 10)


def test_empty_table(none):
    assert divergence.audit(none).collect() == []
