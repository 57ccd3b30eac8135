"""Operator 12, SentencePiece encoding and decoding by a score-ordered agenda.

A merge-type vocabulary joins adjacent symbols, best score first and leftmost
among equals, until no adjacent pair is a piece.  ``Pieces.merge`` keeps the
pairs on an agenda (a heap); an entry is stale once one of its symbols has
grown or gone.  Pairs never join across a place where no piece of the
vocabulary has its two characters side by side, so a text is cut at spaces and
line ends wherever the vocabulary allows it, and what a cut-out stretch gives is
remembered: the ids are those of the whole text's agenda.  The new stretches of
a batch share one agenda (``merge_all``): each round takes the best entry of
every stretch.  Characters outside the vocabulary fall back to bytes, or to the
unknown id.

The model file is read on the driver (under 1 MB) and sent with the function;
the library normalises the texts and, in the same Arrow batch, encodes and
decodes them again as a check (column ``agrees``).

Defined cases: a null text is empty; an empty text has the begin and end ids
only and decodes to an empty one; very long texts and texts without spaces are
encoded whole; repeated rows get equal results; a null doc_id is kept; an
empty table gives no rows; further columns are dropped.  Ids outside the
vocabulary, null ids and models that aren't of the merge type or hold
user-defined or unused pieces are refused with an error.  A null list of ids
decodes as an empty one.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.frames import arrow_map, read

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches that a worker remembers, and the most characters of one that joins the shared agenda.
REMEMBERED, WIDEST = 300_000, 64
#: Characters of the texts that are worked on at a time (a longer text alone).
TOGETHER = 1 << 20
#: Rank of a pair that is no piece.
NEVER = np.int64(1 << 30)
#: Fixed values of the model format: kinds of pieces, and the number of the merge type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def fields(message: bytes) -> dict[int, list]:
    """Values of a serialised message by field number: integers, or bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 128:
                return value, at

    found: dict[int, list] = {}
    at = 0
    while at < len(message):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = message[at : at + size], at + size
        found.setdefault(tag >> 3, []).append(value)
    return found


class Pieces:
    """A merge-type vocabulary: encodes normalised texts, decodes ids."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = fields(model)
        trained, normal = fields(parts[2][0]), fields(parts.get(3, [b""])[0])
        pieces = [fields(p) for p in parts[1]]
        names = [p.get(1, [b""])[0].decode() for p in pieces]
        kinds = [p.get(3, [NORMAL])[0] for p in pieces]
        if trained.get(3, [1])[0] != MERGE_TYPE or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("a model of the merge type without user-defined or unused pieces is needed")
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == NORMAL}
        self.cost = {name: -self.library.get_score(i) for name, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        bytes_at = {int(name[3:5], 16): i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == BYTE}
        self.byte_ids = [bytes_at[b] for b in range(256)] if trained.get(35, [0])[0] else None
        self.begin, self.end = (np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (self.library.bos_id(), self.library.eos_id()))
        self.opens = [bool(normal.get(3, [1])[0] or normal.get(4, [1])[0]), bool(normal.get(4, [1])[0])]  # a leading space goes; all of them
        surface = trained.get(44, [" ⁇ ".encode()])[0]
        self.surfaces = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else surface if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.spaced = {i for name, i in self.ids.items() if name.startswith(SPACE)}
        self.silent = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        within = {a + b for name in self.ids for a, b in zip(name, name[1:], strict=False)}
        lone = "".join(c for c in "\n\r\t" if not any(c in pair for pair in within))
        words = not any(b == SPACE != a for a, b in within)
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|[{lone}]" if words and lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if words else ".+", re.DOTALL)
        self.known: dict[str, bytes] = {}
        self.letters = {name for name in self.ids if len(name) == 1}
        self.alphabet = np.full(0x110000, -1, np.int32)
        for name in self.letters:
            self.alphabet[ord(name)] = self.ids[name]
        ranks = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        joins = [(self.ids[name[:k]] << 32 | self.ids[name[k:]], ranks[self.cost[name]], i) for name, i in self.ids.items() for k in range(1, len(name)) if name[:k] in self.ids and name[k:] in self.ids]
        self.pairs, self.rank, self.joined = (np.array(x, np.int64) for x in zip(*sorted(joins), strict=True)) if joins else (np.zeros(1, np.int64) - 1,) * 3

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text, by the agenda alone."""
        symbols, cost = list(text), self.cost
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            if (price := cost.get(joined)) is not None:
                heapq.heappush(agenda, (price, left, right, len(joined)))

        for right in range(1, len(symbols)):
            offer(right - 1, right)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                offer(left, following)
            if before[left] >= 0:
                offer(before[left], left)
        out: list[int] = []
        for symbol in filter(None, symbols):
            if (i := self.ids.get(symbol)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in symbol.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # neighbours that are unknown are one
        return out

    def entries(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (lower joins first; ``NEVER`` if the pair is no piece) and joined id of pairs of ids."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        found = self.pairs[at] == pair
        return np.where(found, self.rank[at], NEVER), self.joined[at]

    def merge_all(self, stretches: list[str]) -> list[bytes]:
        """Packed ids of stretches whose characters are all pieces; one agenda holds the pairs of all of them."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        symbol = self.alphabet[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)].astype(np.int64)
        of = np.repeat(np.arange(len(stretches)), sizes)
        rank, joined = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner], joined[inner] = self.entries(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            open_ = best >> 32 < NEVER
            if not open_.all():
                ended = np.repeat(~open_, np.diff(np.r_[starts, len(symbol)]))
                done.append((of[ended], symbol[ended]))
                symbol, of, rank, joined = (x[~ended] for x in (symbol, of, rank, joined))
                continue
            at = best & 0xFFFFFFFF
            symbol[at] = joined[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, of, rank, joined = (x[keep] for x in (symbol, of, rank, joined))
            at -= np.arange(len(at))
            rank[at] = NEVER
            for left in (at[(at + 1 < len(of)) & (of[np.minimum(at + 1, len(of) - 1)] == of[at])], at[(at > 0) & (of[at - 1] == of[at])] - 1):
                rank[left], joined[left] = self.entries(symbol[left], symbol[left + 1])
        of, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        packed = symbol[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(np.bincount(of, minlength=len(stretches)))).tolist()]
        return [packed[a:b] for a, b in itertools.pairwise(ends[: len(stretches) + 1])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Begin id, ids, end id of each text; each id little-endian in 32 bits."""
        cut = [self.cuts.findall(self.library.normalize(t)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*cut)
        short = [s for s in new if len(s) <= WIDEST and self.letters.issuperset(s)]
        rest = new.difference(short)
        self.known.update(zip(short, self.merge_all(short), strict=True))
        self.known.update((s, np.array(self.merge(s), "<u4").tobytes()) for s in rest)
        find = self.known.__getitem__
        packed = [b"".join([self.begin, *map(find, stretches), self.end]) for stretches in cut]
        for stretch in rest:
            if len(stretch) > WIDEST:
                del self.known[stretch]
        return packed

    def decode(self, ids: list[int]) -> str:
        """Text of ids; runs of bytes that are no characters become marks, and a control id ends such a run."""
        out: list[str] = []
        opening, low = self.opens[0], 0
        for high in [*(k for k, i in enumerate(ids) if i in self.silent), len(ids)] if not self.silent.isdisjoint(ids) else [len(ids)]:
            surfaces = list(map(self.surfaces.__getitem__, ids[low:high]))
            for k, i in enumerate(ids[low:high] if opening else ()):
                if i in self.spaced:
                    surfaces[k] = surfaces[k].lstrip(b" ") if self.opens[1] else surfaces[k][1:]
                opening = self.opens[1] and not surfaces[k]
                if not opening:
                    break
            out.append(b"".join(surfaces).decode("utf-8", "each_byte"))
            low = high + 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Pieces:
    return Pieces(model)


def model_bytes(path: str | None = None) -> bytes:
    """The model file; without a path, that of the installed public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as file:
        return file.read()


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in groups of at most ``TOGETHER`` characters or of one text."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def agreeing(pieces: Pieces, texts: list[str], packed: list[bytes], decoded: list[str]) -> list[bool]:
    """Whether the library gives the same ids and the same decoded text, text by text."""
    theirs = pieces.library.encode(texts, add_bos=bool(pieces.begin), add_eos=bool(pieces.end), num_threads=1)
    back = pieces.library.decode(theirs, num_threads=1)
    return [np.array(t, "<u4").tobytes() == p and b == d for t, p, b, d in zip(theirs, packed, back, decoded, strict=True)]


def unpacked(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (begin and end ids included) of every text."""
    held = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(held)
        for batch in batches:
            packed = [p for group in together([t or "" for t in batch.column("text").to_pylist()]) for p in pieces.encode(group)]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every list of ids (null: empty); an id that is null or outside the vocabulary is an error."""
    held = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(held)
        for batch in batches:
            lists = [ids or [] for ids in batch.column("ids").to_pylist()]
            for ids in lists:
                if ids and (None in ids or not 0 <= min(ids) <= max(ids) < len(pieces.surfaces)):
                    raise ValueError("an id isn't in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pieces.decode(ids) for ids in lists], pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Number and digest of each text's ids, digest of what they decode to, and whether the library agrees on both."""
    held = model_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(held)
        for batch in batches:
            found: list[tuple] = []
            for texts in together([t or "" for t in batch.column("text").to_pylist()]):
                packed = pieces.encode(texts)
                decoded = [pieces.decode(unpacked(p)) for p in packed]
                same = agreeing(pieces, texts, packed, decoded)
                found += [(len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(d.encode()).hexdigest(), s) for p, d, s in zip(packed, decoded, same, strict=True)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")


def op12_score_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
