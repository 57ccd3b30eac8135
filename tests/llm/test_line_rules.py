import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import line_rules, sql
from quillgraph.llm import textkit as tk

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeat = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def brute(rows, least=line_rules.LEAST_DOCUMENTS, percent=line_rules.SHARE_PERCENT, left=line_rules.MIN_LEFT, keep_first=False):
    """(doc_id, counts, base_failed, kept, lines removed, words removed), by definition."""
    norm = lambda line: " ".join(WORD.findall(line.translate(LOWER)))
    carriers, documents = defaultdict(set), defaultdict(set)
    for doc, text, _, host, *_ in rows:
        key = (doc, text if doc is None else "")
        documents[host].add(key)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                carriers[host, norm(line)].add(key)
    out = []
    for doc, text, _, host, *_ in rows:
        n = base(text)
        gone = []
        for x in (text or "").split("\n"):
            if WORD.search(x):
                c = carriers[host, norm(x)]
                first = keep_first and doc == min((i for i, _ in c if i is not None), default=None)
                if len(c) > least and 100 * len(c) > percent * len(documents[host]) and not first:
                    gone.append(x)
        words = sum(len(WORD.findall(x)) for x in gone)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        out.append((doc, *n, failed, not failed and n[0] - words >= n[0] * left, len(gone), words))
    return out


def columns(df):
    return [tuple(r[k] for k in ("doc_id", *line_rules.COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_removed")) for r in df.collect() for _ in range(r["rows"])]


@pytest.mark.parametrize("limits", [{}, {"least": 2, "percent": 0}, {"least": 1, "percent": 10}, {"least": 1, "percent": 1, "keep_first": True}, {"least": 0, "percent": 0}])
def test_counts_and_verdicts(spark, docs, rows, limits):
    named = {"left" if k == "min_left" else k: v for k, v in limits.items()}
    assert Counter(columns(line_rules.judge(docs, **limits))) == Counter(brute(rows, **named))


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def body(i):
    return "\n".join(" ".join(f"w{i}x{k}y{j}" for j in range(20)) for k in range(3))


def test_frequent_lines_go(spark):
    rows = [(i, "Shared  Line here\n" + body(i), "en", "a", 0) for i in range(8)] + [(20 + i, "shared line HERE\n" * 2 + f"only {i}\n", "en", "b", 0) for i in range(6)] + [(40, "same text " * 60, "en", "a", 0)] * 5
    df = spark.createDataFrame(rows, PLAIN)
    for first in (False, True):
        got = columns(line_rules.judge(df, least=3, percent=0, keep_first=first))
        assert Counter(got) == Counter(brute(rows, 3, 0, keep_first=first))
        kept = {r.doc_id: r.text for r in line_rules.clean(df, least=3, percent=0, keep_first=first).collect()}
        assert set(kept) == set(range(8))  # the text of 40 repeats its words, the b documents are short
        assert kept[0] == (rows[0][1] if first else body(0)) and kept[5] == body(5)


def test_a_share_of_the_host_counts(spark):
    """A line of 12 documents is frequent on a host of 100, not on one of 400."""
    rows = [(i, ("shared line\n" if i < 12 else "") + body(i), "en", "small", 0) for i in range(100)]
    rows += [(1000 + i, ("shared line\n" if i < 12 else "") + body(i), "en", "large", 0) for i in range(400)]
    got = {r.doc_id: r.n_lines_removed for r in line_rules.judge(spark.createDataFrame(rows, PLAIN)).collect()}
    assert {i for i, n in got.items() if n} == set(range(12))


def test_copies_of_a_document_count_each_and_the_first_is_kept_on_request(spark):
    rows = [(i, body(0), "en", "a", 0) for i in range(30)] + [(100 + i, body(100 + i), "en", "a", 0) for i in range(30)]
    df = spark.createDataFrame(rows, PLAIN)
    kept = lambda **x: {r.doc_id for r in line_rules.judge(df, **x).where("kept").collect()}
    assert kept() == {100 + i for i in range(30)}
    assert kept(keep_first=True) == {0, *(100 + i for i in range(30))}


def test_depleted_documents_are_rejected(spark):
    block = "\n".join(f"common words of line {k} " * 4 for k in range(4))
    rows = [(i, block + "\n" + " ".join(f"own{i}x{k}" for k in range(3)), "en", "a", 0) for i in range(6)]
    got = {r.doc_id: r.kept for r in line_rules.judge(spark.createDataFrame(rows, PLAIN), least=2, percent=0).collect()}
    assert not any(got[i] for i in range(1, 6))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("limits", [{}, {"least": 1, "percent": 1}, {"least": 1, "percent": 0, "min_left": 0.97}])
def test_tables_against_sql(spark, limits):
    """At lower limits lines go from the driver's tables and documents are depleted."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", *line_rules.COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_removed"]
    expected = con.sql(f"SELECT {', '.join(names)} FROM ({sql.op1(**limits)})").fetchall()
    got = columns(line_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), **limits))
    assert Counter(got) == Counter(expected)
    if limits:
        assert sum(r[8] for r in got) > 10 and any(r[9] and not r[6] and not r[7] for r in got)


def test_empty(spark, none):
    assert line_rules.judge(none).count() == 0
    assert line_rules.clean(none).count() == 0


def test_kernel_rows_do_not_leak():
    texts = ["a b", "", None, "c", "d  e\nf", "  ", "é g"]
    (_, _, buf, offs), = tk.chunks(pa.array(texts))
    starts, ends, index = tk.runs(tk.NOT_SPACE[buf], offs)
    assert np.diff(index).tolist() == [2, 0, 0, 1, 3, 0, 2]
    assert [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "d", "e", "f", "é", "g"]
    spans = tk.RangeHash(np.frombuffer(b"xyzabcabc", np.uint8))
    h = spans(np.array([3, 6, 0]), np.array([6, 9, 3]))
    assert h[0] == h[1] != h[2]
