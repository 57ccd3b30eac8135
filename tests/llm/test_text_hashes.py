"""Hashes of ranges."""

import numpy as np

from quillgraph.llm import line_rules
from quillgraph.llm import textkit as tk


def thue_morse(n, swapped=False):
    return "".join("ab"[(i.bit_count() + swapped) % 2] for i in range(n))


def test_self_similar_texts_have_hashes_of_their_own():
    for n in (64, 512, 1024, 2048, 4096):
        raw = np.frombuffer((thue_morse(n) + "\n" + thue_morse(n, True)).encode(), np.uint8)
        one, other = tk.RangeHash(raw)(np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert one != other
        measured = line_rules.measure(raw, np.array([0, len(raw)]))
        assert measured["n_dup_lines"].tolist() == [0]
        assert measured["line_hash"][0] != measured["line_hash"][1]


def test_equal_ranges_have_equal_hashes_at_any_place():
    rng = np.random.default_rng(0)
    piece = rng.integers(0, 256, 700).astype(np.uint8)
    raw = np.concatenate([rng.integers(0, 256, 33).astype(np.uint8), piece, rng.integers(0, 256, 5).astype(np.uint8), piece])
    for width in (1, 5, tk.WIDE - 1, tk.WIDE, 700):
        a, b = tk.RangeHash(raw)(np.array([33, 738]), np.array([33, 738]) + width)
        assert a == b
    words = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    again = tk.RangeHash(np.r_[words, words])
    assert again(np.array([0]), np.array([400])) == again(np.array([400]), np.array([800]))
