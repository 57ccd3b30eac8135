"""Operator 10, secret scans by token efficiency.

Fixed patterns find assignments, access keys and long hexadecimal strings.
The token-efficiency test adds strings that a byte-pair vocabulary learned
from ordinary text can't compress: a run of at least ``MIN_RUN`` key
characters is exposed if it has fewer than ``MAX_RATIO`` characters a token,
after known digests (hexadecimal strings of a digest's length) and identifiers
(UUIDs, numbers, times and words, alone or joined by separators) are excluded.  A
word here has letters of one case, the first of which may be a capital: random
letters of a single case can't be told from words of a language that the
vocabulary doesn't know (both have 1.6 to 2.2 characters a token) and are left
to the fixed patterns.  Of random letters of both cases, or of letters and
digits, 99 in 100 have a ratio up to 1.8 at 16 characters, and names in source
code over 2.2.

Whole texts are read; a vectorised pass over the bytes finds the texts that
can have a span, and only these are decoded.  Defined cases: a null or empty
text has no spans (``spans`` is then empty, not null); repeated rows get equal
results; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import textkit as tk
from quillgraph.llm.frames import arrow_map, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_RUN = 16
MAX_RATIO = 2.0
KINDS = ("assign", "access", "hex", "token")
#: Fixed patterns and the least characters of the part that decides.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Fixed pattern of a digest's hexadecimal lengths, of UUIDs, and of words and numbers joined by separators.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[0-9]+T[0-9]+Z?)[-_/=+]+)*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[0-9]+T[0-9]+Z?)[-_/=+]*)\Z"
)
KEY_CHARS = tk.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
HEX_CHARS = tk.byte_table(b"0123456789abcdef")
DIGITS = tk.byte_table(b"0123456789")
UPPER = tk.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = tk.byte_table(b"abcdefghijklmnopqrstuvwxyz")
#: Pre-tokenisation pattern that belongs to the vocabulary file (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    """Byte-pair encoder of the lines of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("secrets", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping in each kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(*m.span(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def token_spans(text: str, encode) -> list[tuple[int, int, str]]:
    """Spans that only the token-efficiency test exposes."""
    found = []
    for m in RUN.finditer(text):
        if not KNOWN.match(m[0]) and len(m[0]) < MAX_RATIO * len(encode(m[0])):
            found.append((*m.span(), "token"))
    return found


def suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that can have a span: a hex run or key run that is long enough; rows with a key word are found apart."""
    starts, ends, index = tk.runs(KEY_CHARS[buf], offs)
    long = np.flatnonzero(ends - starts >= MIN_RUN)
    digits, upper, lower = (of[ends[long]] - of[starts[long]] for of in (np.r_[0, np.cumsum(x[buf])] for x in (DIGITS, UPPER, LOWER)))
    mixed = np.zeros(len(starts), bool)
    mixed[long] = (digits > 0) & (upper + lower > 0) | (upper > 0) & (lower > 0)
    odd = tk.per_row(mixed, index)
    starts, ends, index = tk.runs(HEX_CHARS[buf], offs)
    return odd + tk.per_row(ends - starts >= LEAST["hex"], index) > 0


def _batch_spans(texts: pa.Array, encode) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start and kind."""
    spans: list[list[tuple[int, int, str]]] = []
    for _, _, buf, offs in tk.chunks(texts):
        odd = suspects(buf, offs)
        for i, (low, high) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            raw = buf[low:high].tobytes()
            plain = raw.lower()
            if not odd[i] and b"AKIA" not in raw and not any(w in plain for w in WORDS):
                spans.append([])
                continue
            text = raw.decode()
            extra = token_spans(text, encode) if odd[i] else []
            spans.append(sorted(base_spans(text) + extra, key=lambda x: (x[0], KINDS.index(x[2]))))
    return spans


def _scanner(vocabulary: bytes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            spans = _batch_spans(batch.column("text"), encode)
            joined = [",".join(f"{k}:{a}:{b}" for a, b, k in s) for s in spans]
            base = [",".join(f"{k}:{a}:{b}" for a, b, k in s if k != "token") for s in spans]
            counts = [pa.array([sum(x[2] == k for x in s) for s in spans], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array(joined, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return scan


def vocabulary_bytes(path: str) -> bytes:
    """The vocabulary file (under 1 MB), read once by the driver and sent with the function."""
    with open(path, "rb") as file:
        return file.read()


def scan(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, counts of each kind, digest of the base spans, and all spans."""
    return arrow_map(documents.select("doc_id", "text"), _scanner(vocabulary_bytes(vocabulary)), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def without_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch that spans cover replaced by ``[secret]``."""
    pieces, at = [], 0
    for low, high, _ in spans:
        if high > at:
            if low >= at:
                pieces += [text[at:low], "[secret]"]
            at = high
    return "".join(pieces) + text[at:]


def _redacter(vocabulary: bytes):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            spans = _batch_spans(batch.column("text"), encode)
            texts = [without_spans(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source")], ["doc_id", "text", "lang", "source"])

    return redact


def redact(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with each span (overlapping ones as one) replaced by ``[secret]`` (columns of documents)."""
    clean = arrow_map(documents.select("doc_id", "text", "lang", "source"), _redacter(vocabulary_bytes(vocabulary)), "doc_id long, text string, lang string, source string")
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def op10_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token")
