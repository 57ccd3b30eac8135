"""Licenses with words inserted or left out."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import licenses

BASE = set(licenses.BASE_PHRASES.values())
KNOWN = licenses.vocabulary(licenses.TEMPLATES)
INDEX = licenses.build_index(licenses.TEMPLATES, KNOWN, 1000, np.ones(len(KNOWN), np.int64))


def labels(text):
    return set(filter(None, licenses.scan_batch(pa.array([text]), INDEX)["labels"][0].split(",")))


@pytest.mark.parametrize("inserted", [4, 8, 12])
def test_inserted_words_lose_no_license_and_give_no_wrong_one(inserted):
    """In notices of over 13 words; in a shorter one as many words again may be in between, and it is another text then."""
    for label, text, _ in licenses.TEMPLATES:
        words = text.split()
        for at in (len(words) // 3, len(words) // 2, 2 * len(words) // 3):
            got = labels(" ".join(words[:at] + [f"zq{i}" for i in range(inserted)] + words[at:]))
            if len(words) > 13:
                assert got - BASE == labels(text) - BASE, (label, at)
            assert got <= labels(text)


def test_two_insertions_and_a_left_out_line():
    by_label = {label: text for label, text, _ in licenses.TEMPLATES}
    for label in ("bsd-3-clause", "mit"):
        words = by_label[label].split()
        third = len(words) // 3
        twice = words[:third] + ["zq"] * 6 + words[third : 2 * third] + ["zr"] * 9 + words[2 * third :]
        assert labels(" ".join(twice)) - BASE == {label} - BASE
        assert labels(" ".join(words[: third + 4] + words[third + 9 :])) - BASE == {label} - BASE


def test_words_of_licenses_at_random_are_none():
    rng = random.Random(9)
    vocabulary = [w for _, text, _ in licenses.TEMPLATES for w in text.split()]
    for _ in range(60):
        assert labels(" ".join(rng.choices(vocabulary, k=500))) <= BASE


def test_phrases_in_order():
    order = lambda span, phrase: licenses.in_order(np.array(span, np.uint64), np.array(phrase, np.uint64), np.array([1, 2, 3, 4], np.uint64))
    assert order([5, 1, 9, 9, 2, 9, 3, 1], [1, 2, 3]) and not order([5, 1, 9, 9, 2, 9, 3, 1], [3, 2, 1])
    assert not order([1, 4, 2], [1, 2]) and order([1, 4, 1, 9, 2], [1, 2])
    assert order([1] + [9] * licenses.GAP + [2], [1, 2]) and not order([1] + [9] * (licenses.GAP + 1) + [2], [1, 2])
