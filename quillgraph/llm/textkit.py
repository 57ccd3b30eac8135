"""Vectorised kernel over the bytes of whole Arrow string columns.

Every function works on a *chunk*: consecutive rows of one record batch whose
bytes lie in one ``uint8`` array ``buf``, row ``i`` being
``buf[offs[i]:offs[i + 1]]``.  A chunk holds about ``CHUNK_BYTES`` bytes (more
only where a single text is longer), which bounds the temporary arrays of a
worker whatever the batch size.  A null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 19
U64 = np.uint64
#: Ranges from this width on are hashed from their bytes: prefix sums modulo 2**64 collide on long self-similar sequences (Thue-Morse).
WIDE = 128
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


#: A pseudo-random odd number for each byte value, by rule.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_BASE)) | U64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(n + n // 4 + 1024, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0], _powers[1]


class RangeHash:
    """64-bit hashes of any ranges of a sequence: from prefix sums modulo 2**64 in constant time, or if ``WIDE`` by XXH3 of the bytes."""

    def __init__(self, values: np.ndarray):
        self._raw = np.ascontiguousarray(values)
        if values.dtype == np.uint8:
            values = _BYTE[values]
        power, self._inverse = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        width = (end - start).astype(np.uint64)
        out = mix((self._sums[end] - self._sums[start]) * self._inverse[start] + width * U64(0xA24BAED4963EE407))
        wide = np.flatnonzero(width >= WIDE)
        if len(wide):
            spans = zip(start[wide].tolist(), end[wide].tolist(), strict=True)
            out[wide] = np.fromiter((xxhash.xxh3_64_intdigest(self._raw[a:b]) for a, b in spans), np.uint64, len(wide))
        return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, count=len(column) + 1, offset=column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int64)
    offs = offs.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within these bytes) of successive chunks."""
    buf, offs = column_bytes(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, stop, buf[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def byte_table(chars: bytes | range) -> np.ndarray:
    """Lookup table that is True for the given byte values."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal True runs, none crossing a row, and the index of each row's first run (with the total last)."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def owners(index: np.ndarray) -> np.ndarray:
    """Row of each run, from the index that ``runs`` gives."""
    return np.repeat(np.arange(len(index) - 1), np.diff(index))


def per_row(flags: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of flags over each row's range ``index[i]:index[i + 1]``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[index[1:]] - total[index[:-1]]


def unique_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs in ascending order."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
