"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quillgraph.llm import sentence_pieces as sp

MODEL = sp.model_bytes()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(MODEL)


def test_messages():
    assert sp.fields(b"\x08\x96\x01\x12\x02hi\x1d\x00\x00\x80\x3f") == {1: [150], 2: [b"hi"], 3: [b"\x00\x00\x80\x3f"]}


def hard_texts():
    rng = random.Random(12)
    alphabet = list("ab cdeß▁ \n\t\0é漢字🎉́  ABC.,<s>0x")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return texts + ["", " ", " " * 40 + "x", "▁a", "<s>a</s>", "a" * 3000, " " * 3000, "e" * 5 + " " * 17 + "\n\n", "the quick brown fox " * 500, "漢字かな交じり文" * 400]


def test_ids_and_texts_are_the_library_s(pieces, library):
    texts = hard_texts()
    packed = pieces.encode(texts)
    theirs = library.encode(texts, add_bos=True, add_eos=True)
    assert [sp.unpacked(p) for p in packed] == theirs
    assert [pieces.decode(ids) for ids in theirs] == library.decode(theirs)


def test_stretches_give_what_the_whole_text_s_agenda_gives(pieces, library):
    for text in hard_texts()[::7]:
        whole = pieces.merge(library.normalize(text)) if text else []
        assert [1, *whole, 2] == sp.unpacked(pieces.encode([text])[0])


def test_forgetting_changes_nothing(pieces, library, monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED", 50)
    texts = hard_texts()[:300]
    for low in range(0, 300, 20):
        assert [sp.unpacked(p) for p in pieces.encode(texts[low : low + 20])] == library.encode(texts[low : low + 20], add_bos=True, add_eos=True)
        assert len(pieces.known) < 2000
    pieces.known.clear()


def test_any_ids_decode_as_in_the_library(pieces, library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_query_columns(docs, rows, library):
    got = sp.digests(docs).collect()
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        expected.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    assert sorted(map(repr, got_rows(got))) == sorted(map(repr, expected))


def got_rows(rows):
    return [tuple(r) for r in rows]


def test_round_trip(docs, rows):
    back = sp.decode(sp.encode(docs)).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(r[0]), (r[1] or "").replace("▁", " ")) for r in rows)


def test_empty_table(none):
    assert sp.digests(none).collect() == [] and sp.encode(none).collect() == []


def test_ids_outside_the_vocabulary(spark):
    with pytest.raises(Exception, match="isn't in the vocabulary"):
        sp.decode(spark.createDataFrame([(1, [5, 99999])], "doc_id long, ids array<int>")).collect()
    assert sp.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def model(kind: int, pieces: list[tuple[bytes, int]]) -> bytes:
    """A small serialised model: piece texts and kinds, and the type of the model."""
    out = b""
    for text, k in pieces:
        body = b"\x0a" + bytes([len(text)]) + text + b"\x15\x00\x00\x00\x00\x18" + bytes([k])
        out += b"\x0a" + bytes([len(body)]) + body
    trainer = b"\x18" + bytes([kind])
    return out + b"\x12" + bytes([len(trainer)]) + trainer


@pytest.mark.parametrize("kind, extra", [(1, 1), (2, 4), (2, 5)])
def test_other_models_are_refused(kind, extra):
    with pytest.raises(ValueError, match="merge type"):
        sp.Pieces(model(kind, [(b"<unk>", 2), (b"<s>", 3), (b"</s>", 3), (b"a", 1), (b"b", extra)]))


def test_unknown_characters_without_bytes():
    small = model(2, [(b"<unk>", 2), (b"<s>", 3), (b"</s>", 3), (b"a", 1), (b"\xe2\x96\x81", 1), (b"\xe2\x96\x81a", 1)])
    pieces, theirs = sp.Pieces(small), sentencepiece.SentencePieceProcessor(model_proto=small)
    texts = ["a", "aa a", "xyz", "a xx a", "", " a", "xa x"]
    ids = theirs.encode(texts, add_bos=True, add_eos=True)
    assert [sp.unpacked(p) for p in pieces.encode(texts)] == ids
    assert [pieces.decode(i) for i in ids] == theirs.decode(ids)
