"""License scans of long documents with several notices."""

import itertools

from quillgraph.llm import licenses

LONG = [1, 5, 6, 11]


def test_every_notice_of_a_long_document_is_found(spark):
    """Long license texts, then words that many templates index, then each notice in turn."""
    filler = " ".join(f"filler{i} {w}" for i, w in enumerate(sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()})))
    whole = " . ".join(licenses.TEMPLATES[k][1] for k in LONG)
    rows = [(k, f"{whole} {filler} middle {text} end") for k, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows += [(100, " middle words ".join(text for _, text, _ in licenses.TEMPLATES)), (101, filler)]
    rows += [(200 + i, f"{licenses.TEMPLATES[a][1]} and {licenses.TEMPLATES[b][1]}") for i, (a, b) in enumerate(itertools.permutations(range(len(licenses.TEMPLATES)), 2))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {licenses.TEMPLATES[k][0] for k in LONG}
    assert all(base | {label} <= got[k] for k, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert {label for label, _, _ in licenses.TEMPLATES} <= got[100]
    assert all({licenses.TEMPLATES[a][0], licenses.TEMPLATES[b][0]} <= got[200 + i] for i, (a, b) in enumerate(itertools.permutations(range(len(licenses.TEMPLATES)), 2)))
    assert got[101] <= {"", "mit", "apache", "gpl"}
