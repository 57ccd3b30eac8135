"""Operator 9, license scans by a positional rare-token index.

Every document is taken as a sequence of words (A-Z lower-cased runs of
letters and digits).  The templates' words are counted over all documents,
and each template is indexed by its ``INDEX_WORDS`` rarest ones (highest
inverse document frequency), with their places.  A file looks up every place
of its indexed words, whose number the templates fix, so one notice never
takes the look-ups of another; the postings of a template are intersected with
the file's places by relative position, that is, votes are counted for each (template, place in the file where it would begin).  For an
alignment with enough votes the share of the template's words found at their
places (up to ``SLACK`` words off) is its score; it is a match from
``MIN_SCORE`` on, if the template's mandatory key phrases stand in the
aligned span.  Alignments of a template that are up to twice ``GAP`` words
apart are chained: words inserted into a notice, or left out, move what
follows, and the share is that of words found in order, less ``STEP`` for each
place moved; phrases may then have as many words in between.  A match inside a
longer one of another license is part of that.

The base rules are three phrases found as consecutive words; their labels
always stay.

Defined cases: a null or empty text has no words, no places (null
``first_word``/``last_word``), empty labels and the score 0; repeated rows
get equal results; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, read

INDEX_WORDS = 16
MIN_VOTES = 3
MIN_SCORE = 0.6
SLACK = 3
#: Words that an insertion can have, the least score of a notice with insertions, and what each inserted or missing word takes off, in words.
GAP, MIN_CHAIN, STEP = 12, 0.75, 0.25
#: Share of a template's indexed places that must be met for a chain.
CHAIN_VOTES = 0.6
WORD = tk.byte_table(b"abcdefghijklmnopqrstuvwxyz0123456789") | (np.arange(256) >= 128)

#: Phrases of the base rules and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.5

#: Label, notice or license text, mandatory key phrases.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2 0"]),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["apache license", "except in compliance with the license"],
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu general public license", "either version 3"],
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ["gnu general public license", "either version 2"],
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["attribution noncommercial 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["attribution 4 0 international"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["attribution sharealike 4 0"]),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["redistribution and use in source and binary forms", "neither the name"],
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use in source and binary forms", "redistributions in binary form"],
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license v 2 0"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license v 2 0"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    (
        "apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        ["apache license version 2 0", "terms and conditions for use"],
    ),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ["gnu general public license version 3"]),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.", ["gnu general public license version 2"]),
    (
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ["gnu lesser general public license", "either version 2 1"],
    ),
    (
        "lgpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu lesser general public license", "either version 3"],
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu affero general public license", "either version 3"],
    ),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ["gnu affero general public license", "version 3"]),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ["eclipse public license", "2 0"],
    ),
    (
        "cc0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
        ["to the extent possible under law", "public domain"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software released into the public domain"],
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ["permission is granted to anyone to use this software for any purpose", "redistribute it freely"],
    ),
]


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each row's first word (with the total last)."""
    low = tk.LOWER[buf]
    starts, ends, index = tk.runs(WORD[low], offs)
    return tk.RangeHash(low)(starts, ends), index


def hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def vocabulary(templates: list) -> np.ndarray:
    return np.unique(np.concatenate([hashed(text) for _, text, _ in templates]))


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each value in a short ascending array, -1 where it is none of them."""
    low = np.zeros(1 << 16, bool)
    low[(among & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(values & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(among, values[maybe]), len(among) - 1)
    out = np.full(len(values), -1, np.int64)
    out[maybe] = np.where(among[at] == values[maybe], at, -1)
    return out


def document_frequencies(documents: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents and, for each of the templates' words, of those that have it; one small row a batch and word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(words), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, buf, offs in tk.chunks(batch.column("text")):
                word, index = word_hashes(buf, offs)
                at = member(word, words)
                key = np.unique(tk.owners(index)[at >= 0] * len(words) + at[at >= 0])
                total += np.bincount(key % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(len(words))]), pa.array(np.r_[rows, total])], ["word", "n"])

    counts = dict(arrow_map(documents.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n")).collect())
    return counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(words))], np.int64)


@dataclass
class Index:
    """Templates' words and places; the vocabulary; postings of the rare words."""

    labels: list[str]
    words: list[np.ndarray]
    phrases: list[list[np.ndarray]]
    known: np.ndarray
    first: np.ndarray
    template: np.ndarray
    place: np.ndarray
    needed: np.ndarray
    places: np.ndarray


def build_index(templates: list, known: np.ndarray, documents: int, frequency: np.ndarray) -> Index:
    words = [hashed(text) for _, text, _ in templates]
    idf = np.log((1 + documents) / (1 + frequency))
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, -idf))] = np.arange(len(known))
    postings, needed, indexed = [], [], []
    for t, sequence in enumerate(words):
        at = np.searchsorted(known, sequence)
        rare = np.unique(at)[np.argsort(rank[np.unique(at)])][:INDEX_WORDS]
        places = np.flatnonzero(np.isin(at, rare))
        postings += [(at[q], t, q) for q in places]
        needed.append(min(MIN_VOTES, len(places)))
        indexed.append(len(places))
    postings.sort()
    word, template, place = (np.array(x, np.int64) for x in zip(*postings, strict=True))
    return Index([x for x, _, _ in templates], words, [[hashed(p) for p in ps] for _, _, ps in templates], known, np.searchsorted(word, np.arange(len(known) + 1)), template, place, np.array(needed), np.array(indexed))


def contains(word: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand one after the other."""
    if len(word) < len(phrase):
        return np.zeros(0, np.int64)
    ok = np.ones(len(word) - len(phrase) + 1, bool)
    for k, x in enumerate(phrase):
        ok &= word[k : len(word) - len(phrase) + 1 + k] == x
    return np.flatnonzero(ok)


def alignments(word: np.ndarray, index: np.ndarray, ix: Index) -> np.ndarray:
    """Distinct (row, template, first and last place in the chunk where it would begin) with enough votes.

    Places of one template that are up to twice ``GAP`` words apart are one
    alignment too: words inserted into a notice move the rest of it on.
    """
    at = member(word, ix.known)
    hit = np.flatnonzero((at >= 0) & (ix.first[at + 1] > ix.first[at]))
    at, row = at[hit], tk.owners(index)[hit]
    size = ix.first[at + 1] - ix.first[at]
    which = np.repeat(np.arange(len(at)), size)
    p = np.repeat(ix.first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(at) else np.zeros(0, np.int64)
    if not len(p):
        return np.zeros((4, 0), np.int64)
    # Place in the chunk, so it can be negative or in another row's words; the row is kept beside it.
    begin = hit[which] - ix.place[p]
    least, kinds = int(begin.min()) - 4 * GAP, len(ix.labels)
    wide = int(begin.max()) - least + 1 + 4 * GAP
    key, votes = np.unique((row[which] * kinds + ix.template[p]) * wide + begin - least, return_counts=True)
    of, at = np.divmod(key, wide)
    alone = votes >= ix.needed[of % kinds]
    found = [np.stack([of[alone] // kinds, of[alone] % kinds, at[alone] + least, at[alone] + least])]
    # Two tilings, so that places up to twice GAP apart are in one tile at least; CHAIN_VOTES of the template's indexed places must have a vote there.
    owner, place = row[which] * kinds + ix.template[p], ix.place[p]
    most = max(len(w) for w in ix.words)
    for shift in (0, 2 * GAP):
        tiles = (wide + shift) // (4 * GAP) + 1
        voted = np.unique((owner * tiles + (begin - least + shift) // (4 * GAP)) * most + place) // most
        tile, distinct = np.unique(voted, return_counts=True)
        tile = tile[distinct >= np.maximum(ix.needed, CHAIN_VOTES * ix.places)[tile // tiles % kinds]]
        mine = of * tiles + (at + shift) // (4 * GAP)
        inside = np.flatnonzero(np.isin(mine, tile))
        if len(inside):
            starts = inside[np.r_[True, mine[inside[1:]] != mine[inside[:-1]]]]
            ends = inside[np.r_[mine[inside[1:]] != mine[inside[:-1]], True]]
            moved = at[ends] > at[starts]
            found.append(np.stack([of[starts] // kinds, of[starts] % kinds, at[starts] + least, at[ends] + least])[:, moved])
    return np.unique(np.concatenate(found, axis=1), axis=1)


def score_alignment(word: np.ndarray, low: int, high: int, begin: int, template: int, ix: Index) -> float:
    """Share of the template's words found at their places, 0 if a mandatory phrase is missing."""
    words = ix.words[template]
    a, b = max(low, begin - SLACK), min(high, begin + len(words) + SLACK)
    span = word[a:b]
    if not all(len(contains(span, phrase)) for phrase in ix.phrases[template]):
        return 0.0
    found = np.zeros(len(words), bool)
    for slip in range(-SLACK, SLACK + 1):
        at = np.arange(len(words)) + begin + slip
        ok = (at >= low) & (at < high)
        found[ok] |= word[at[ok]] == words[ok]
    return float(found.mean())


def in_order(span: np.ndarray, phrase: np.ndarray, known: np.ndarray) -> bool:
    """Whether the phrase's words follow each other in the span, with at most ``GAP`` words between two, none of them a word of any template.

    A word that licenses use can make it another one (Lesser, NonCommercial).
    """
    unknown = member(span, known) < 0
    ends = np.flatnonzero(span == phrase[0])
    for x in phrase[1:]:
        following = []
        for end in ends.tolist():
            at = end + 1
            while at < len(span) and at - end <= GAP and unknown[at]:
                at += 1
            if at < len(span) and span[at] == x:
                following.append(at)
        ends = np.array(following, np.int64)
    return bool(len(ends))


def _chain(hits: np.ndarray) -> tuple[float, int]:
    """Most words of a template found in order, and the column where it ends; hits has a row for each word and a column for each place where the template could begin.

    A step on to a later column is an insertion, one back a word left out; each costs ``STEP`` of a word a column.
    """
    slope = STEP * np.arange(hits.shape[1])
    best = np.zeros(hits.shape[1])
    for found in hits:
        best = best + found
        best = np.maximum(np.maximum.accumulate(best + slope) - slope, np.maximum.accumulate((best - slope)[::-1])[::-1] + slope)
    return float(best.max()), int(best.argmax())


def score_chain(word: np.ndarray, low: int, high: int, first: int, last: int, template: int, ix: Index) -> tuple[float, int, int]:
    """Share of the template's words found in order if it begins at a place first..last and is moved on by insertions, 0 if a mandatory phrase is missing; and the places that it spans."""
    words = ix.words[template]
    begins = np.arange(first - SLACK, last + SLACK + 1)
    at = begins[None] + np.arange(len(words))[:, None]
    hits = (at >= low) & (at < high) & (word[np.clip(at, low, high - 1)] == words[:, None])
    found, end = _chain(hits)
    start = hits.shape[1] - 1 - _chain(hits[::-1, ::-1])[1]
    a, b = int(begins[start]), int(begins[end]) + len(words)
    span = word[max(low, a - SLACK) : min(high, b + SLACK)]
    share = found / len(words) if all(in_order(span, phrase, ix.known) for phrase in ix.phrases[template]) else 0.0
    return share, a, b


def outermost(matches: list[tuple[int, int, str]]) -> set[str]:
    """Labels of the matches (begin, end, label) that don't lie in a longer one of another label, as one license can quote a shorter one."""
    return {x for a, b, x in matches if not any(c <= a + SLACK and b - SLACK <= d and d - c > b - a and x != y for c, d, y in matches)}


def scan_batch(column: pa.Array, ix: Index) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    phrases = [(hashed(p), label) for p, label in BASE_PHRASES.items()]
    for _, _, buf, offs in tk.chunks(column):
        word, index = word_hashes(buf, offs)
        rows = len(offs) - 1
        places: list[list[int]] = [[] for _ in range(rows)]
        base: list[set[str]] = [set() for _ in range(rows)]
        more: list[set[str]] = [set() for _ in range(rows)]
        score = [0.0] * rows
        row_of = tk.owners(index)
        for phrase, label in phrases:
            for at in contains(word, phrase).tolist():
                r = int(row_of[at])
                if row_of[at + len(phrase) - 1] == r:
                    places[r].append(at - int(index[r]))
                    base[r].add(label)
                    score[r] = max(score[r], BASE_SCORE)
        matches: dict[int, list[tuple[int, int, str]]] = {}
        weighed: dict[int, list[tuple[int, int, str, float]]] = {}  # with the words found
        chains: dict[int, list[tuple[int, int, str, float]]] = {}
        aligned = alignments(word, index, ix).T.tolist()
        for r, template, first, last in sorted(aligned, key=lambda x: x[2] != x[3]):  # single places before chains
            low, high, label, size = int(index[r]), int(index[r + 1]), ix.labels[template], len(ix.words[template])
            if first == last:
                s = score_alignment(word, low, high, first, template, ix)
                if s >= MIN_SCORE:
                    matches.setdefault(r, []).append((first, first + size, label))
                    weighed.setdefault(r, []).append((first, first + size, label, s * size))
                    score[r] = max(score[r], s)
            elif not any(y == label and first <= c <= last for c, _, y, _ in weighed.get(r, [])):
                s, a, b = score_chain(word, low, high, first, last, template, ix)
                if s >= MIN_CHAIN:
                    chains.setdefault(r, []).append((a, b, label, s))
                    weighed.setdefault(r, []).append((a, b, label, s * size))
        for r, found in chains.items():
            # Of what lies over the same words, the license with more of them is meant.
            for a, b, label, s in found:
                own = max(w for c, d, y, w in weighed[r] if (c, d, y) == (a, b, label))
                if not any(y != label and min(b, d) - max(a, c) > (b - a) / 2 and w > own for c, d, y, w in weighed[r]):
                    matches.setdefault(r, []).append((a, b, label))
                    score[r] = max(score[r], s)
        for r, found in matches.items():
            more[r] = outermost(found)
        out["n_words"] += np.diff(index).tolist()
        out["n_base"] += [len(x) for x in places]
        out["first_word"] += [min(x, default=None) for x in places]
        out["last_word"] += [max(x, default=None) for x in places]
        out["base_labels"] += [",".join(sorted(x)) for x in base]
        out["labels"] += [",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)]
        out["score"] += score
    return out


def scan(documents: DataFrame, templates: list | None = None) -> DataFrame:
    """Word counts, base places and labels, all labels and the score of each document."""
    templates = TEMPLATES if templates is None else templates
    known = vocabulary(templates)
    index = build_index(templates, known, *document_frequencies(documents, known))

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_batch(batch.column("text"), index)
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, types.get(k, pa.int64())) for k, v in found.items())], ["doc_id", *found])

    return arrow_map(documents.select("doc_id", "text"), scan_batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
