"""Recall and false alarms of the token-efficiency test, and its spans against a plain scan."""

import random
import re
import string

import pytest

from quillgraph.llm import secrets

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABETS = {"letters and digits": string.ascii_letters + string.digits, "letters": string.ascii_letters, "capitals and digits": string.ascii_uppercase + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
ORDINARY = """getElementsByTagName SQLAlchemyConnectionPool x86_64-unknown-linux-gnu utf8mb4_general_ci HTTPServerRequestHandler AbstractSingletonProxyFactoryBean
test_user_can_log_in_2 int32_to_float64_conversion node_modules/package/index2 2024-01-02T03-04-05 123e4567-e89b-12d3-a456-426614174000 d41d8cd98f00b204e9800998ecf8427e
org/apache/spark/sql/functions aaaaaaaaaaaaaaaaaaaaaaaa ================ --------------- Donaudampfschifffahrtsgesellschaft ACKNOWLEDGEMENTS einungeinpfberpf DIEENLICHSCHHEIT
kubernetes_deployment_v1beta1 ResNet50ImageClassifier sha256WithRSAEncryption application/x-www-form-urlencoded WindowsPowerShellVersion7 4111-1111-1111-1111
addEventListener2Handler feature/JIRA-1234-login page_number=3/page_size=50 mp4_video_encoder_h264 CamelCaseWithSeveralWords snake_case_with_several_words""".split()


def tokens(name, n=100, low=16, high=64):
    rng = random.Random(name)
    return ["".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.fixture(scope="module")
def encode():
    return secrets.encoder(secrets.vocabulary_bytes(secrets.VOCABULARY)).encode_ordinary


@pytest.mark.parametrize("name", ALPHABETS)
def test_recall(spark, name):
    planted = tokens(name)
    df = spark.createDataFrame([(i, f"é set {t}, then go on", "en", "s", 0) for i, t in enumerate(planted)], PLAIN)
    found = sum(f"token:6:{6 + len(planted[r.doc_id])}" in r.spans for r in secrets.scan(df).collect())
    assert found >= 95


def test_no_false_alarm(spark):
    df = spark.createDataFrame([(i, f"call {t} now", "en", "s", 0) for i, t in enumerate(ORDINARY)], PLAIN)
    assert {ORDINARY[r.doc_id] for r in secrets.scan(df).collect() if r.n_token} == set()


def plain_spans(text, encode):
    """Every run, with the exclusions said in words again, without the pass over bytes."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        run = m[0]
        if re.fullmatch("[0-9a-fA-F]+", run) and len(run) in (32, 40, 56, 64, 96, 128):
            continue
        if re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
            continue
        parts = [p for p in re.split("[-_/=+]+", run) if p]
        if all(p.isdigit() or re.fullmatch("[0-9]+T[0-9]+Z?", p) or (p.isalpha() and (p.islower() or p.isupper() or (p[0].isupper() and p[1:].islower()))) for p in parts) and run[0] not in "-_/=+":
            continue
        if len(run) / len(encode(run)) < 2:
            out.append(f"token:{m.start()}:{m.end()}")
    return out


def test_spans_against_a_plain_scan(spark, encode, rows):
    rng = random.Random(3)
    texts = [r[1] or "" for r in rows]
    for k in range(120):
        pieces = [rng.choice(ORDINARY) for _ in range(5)] + [rng.choice(tokens(name, 5, 10, 40)) for name in ALPHABETS] + ["/a/b1C2d3E4f5G6h7", "ñ", "==Zk9QmX2vLp7RtY4w"]
        rng.shuffle(pieces)
        texts.append(rng.choice([" ", "\n", ", "]).join(pieces))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], PLAIN)
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("token")] for r in secrets.scan(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_spans(text, encode), text
    assert sum(map(len, got.values())) > 100
