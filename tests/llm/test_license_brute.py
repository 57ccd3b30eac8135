"""License scans against a plain search at every place."""

import random
import re

from quillgraph.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def brute_base(words):
    found = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in places(words, phrase)]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({x for _, x in found})


def brute_labels(words):
    """Every template at every place where it could begin, without index or votes."""
    matches = []
    for label, text, phrases in licenses.TEMPLATES:
        t = split(text)
        for begin in range(-len(t), len(words)):
            near = words[max(0, begin - 3) : max(0, begin + len(t) + 3)]
            if all(places(near, " ".join(split(p))) for p in phrases):
                hits = sum(any(0 <= begin + k + slip < len(words) and words[begin + k + slip] == x for slip in range(-3, 4)) for k, x in enumerate(t))
                if hits >= 0.6 * len(t):
                    matches.append((begin, begin + len(t), label))
    return {x for a, b, x in matches if not any(c <= a + 3 and b - 3 <= d and d - c > b - a and x != y for c, d, y in matches)}


def changed(rng, text, share):
    out = []
    for w in text.split():
        draw = rng.random()
        if draw < share / 3:
            continue
        out.append(f"odd{rng.randrange(99)}" if draw < share else w)
        if draw > 1 - share / 3:
            out.append("more")
    return " ".join(out)


def test_against_every_place(spark, rows):
    rng = random.Random(6)
    filler = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()})
    texts = [r[1] for r in rows if len(r[1] or "") < 5000]
    planted: dict[int, set[str]] = {}  # a changed notice may be found by chaining though no single place holds it
    for label, text, _ in licenses.TEMPLATES:
        texts += [text, text.upper(), f"{' '.join(rng.choices(filler, k=30))} {text} {' '.join(rng.choices(filler, k=30))}", changed(rng, text, 0.05)]
        planted[len(texts) - 1] = {label}
    texts += [" ".join(rng.choices(filler, k=300)) for _ in range(5)]
    for _ in range(10):
        chosen = [rng.choice(licenses.TEMPLATES)[:2] for _ in range(3)]
        texts.append(" and ".join(changed(rng, text, 0.03) for _, text in chosen))
        planted[len(texts) - 1] = {label for label, _ in chosen}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    agree = 0
    for i, text in enumerate(texts):
        words = split(text)
        r = got[i]
        *counts, base = brute_base(words)
        assert [r.n_words, r.n_base, r.first_word, r.last_word] == counts and r.base_labels == ",".join(base)
        wanted = brute_labels(words) | set(base)
        found = set(filter(None, r.labels.split(",")))
        assert found <= wanted | planted.get(i, set())
        agree += found == wanted or wanted < found
    # Votes need three rare words at one alignment, so heavily changed notices may be missed.
    assert agree >= 0.97 * len(texts)


def test_a_longer_license_holds_the_shorter_one(spark):
    by_label = {label: text for label, text, _ in licenses.TEMPLATES}
    df = spark.createDataFrame([(0, by_label["bsd-3-clause"]), (1, by_label["bsd-2-clause"]), (2, by_label["bsd-3-clause"] + " then " + by_label["bsd-2-clause"]), (3, by_label["lgpl-2.1"]), (4, by_label["agpl-3.0"])], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {0: "bsd-3-clause", 1: "bsd-2-clause", 2: "bsd-2-clause,bsd-3-clause", 3: "gpl,lgpl-2.1", 4: "agpl-3.0,gpl"}
