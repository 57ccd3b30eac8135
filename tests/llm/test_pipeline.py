"""Stages one after the other, each against what it was given."""

import os
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from quillgraph.llm import line_rules, mixing, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    path = str(folder / "in")
    docs.select(*COLUMNS).write.parquet(path)
    out = [spark.read.parquet(path)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_quality_keeps_what_passes(stages):
    verdict = sorted((str(r.doc_id) for r in line_rules.judge(stages[0], keep_first=True).where("kept").collect() for _ in range(r["rows"])))
    assert verdict == sorted(str(r.doc_id) for r in stages[1].collect())


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_one_of_each_group(stages):
    """Against all pairs of texts: what stays is the first of each group that links of similarity 0.8 join."""
    rows = stages[1].collect()
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for r, k in zip(rows, root, strict=True):
        groups[k].append(r.doc_id)
    assert sorted(min(g, key=lambda x: (x is None, x or 0)) or -1 for g in groups.values()) == sorted(r.doc_id or -1 for r in stages[2].collect())


def test_secrets_go_and_documents_stay(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[2:4])
    assert before.keys() == after.keys()
    assert not any(re.search("AKIA[A-Z0-9]{12}", t or "") for t in after.values())


def test_mix_takes_its_words(stages):
    want = sum(r.taken for r in mixing.mix(stages[3]).collect())
    assert want == sum(len(r.text.split()) for r in stages[4].collect())


def test_packing_takes_every_word(stages):
    assert sum(r.n_words for r in stages[5].collect()) == sum(len(r.text.split()) for r in stages[4].collect())
    assert stages[5].where("bin IS NOT NULL").agg({"bin_offset": "max"}).first()[0] < packing.CAPACITY


def test_run(spark, docs, tmp_path, stages):
    docs.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stages[5].count()


def test_run_leaves_the_last_folder_only(spark, docs, tmp_path):
    docs.select(*COLUMNS).where("doc_id < 10").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    files = out.inputFiles()
    folder = os.path.dirname(os.path.dirname(files[0].removeprefix("file://").removeprefix("file:")))
    assert os.listdir(folder) == [str(len(corpus_pipeline.STAGES) - 1)] and out.count() > 0
