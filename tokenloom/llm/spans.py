"""Vectorised word tables over Arrow string batches.

Texts of a batch are handled as one byte buffer. A *word* is a maximal run of a-z and 0-9
after A-Z became a-z; every other byte separates. Each word gets a 64-bit hash: the sum of
its bytes times powers of an odd base, taken from prefix sums modulo 2**64 and then mixed.
No Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_WORD = np.zeros(256, np.uint8)
for _lo, _hi in ((48, 57), (97, 122)):
    _WORD[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
_WORD[65:91] = np.arange(97, 123)

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:  # one very long text: don't keep its table
            return up[:n], down[:n]
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


class Texts(NamedTuple):
    """UTF-8 bytes of consecutive rows; `offs` has one entry more than there are rows."""

    buf: np.ndarray
    offs: np.ndarray
    valid: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The buffers of a string column, offsets counted from its first row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool))
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else np.asarray(column.is_valid())
    return Texts(buf[offs[0] : offs[-1]], offs - offs[0], valid)


def slices(texts: Texts, limit: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows of about `limit` bytes, so that temporaries stay small; rows are never cut."""
    n, i = len(texts.valid), 0
    while i < n:
        j = int(np.searchsorted(texts.offs, texts.offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        a, b = texts.offs[i], texts.offs[j]
        yield i, j, Texts(texts.buf[a:b], texts.offs[i : j + 1] - a, texts.valid[i:j])
        i = j


class Pieces(NamedTuple):
    """Byte ranges with their row and hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def _runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes, also ended by row limits; their row, start and end."""
    n = len(mask)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    edge = offs[:-1][offs[:-1] < offs[1:]]  # first bytes of rows that have any
    first[edge] = mask[edge]
    last[edge[1:] - 1] = mask[edge[1:] - 1]
    start = np.flatnonzero(first)
    return np.searchsorted(offs, start, "right") - 1, start, np.flatnonzero(last) + 1


def _hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * up[: len(codes)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def words(texts: Texts) -> Pieces:
    codes = _WORD[texts.buf]
    row, start, end = _runs(codes != 0, texts.offs)
    return Pieces(row, start, end, _hash(codes.astype(U64), start, end))


def lines(texts: Texts, blank: bool = False) -> Pieces:
    """Runs between line ends with surrounding white space removed; blank ones are left out."""
    row, start, end = _runs((texts.buf != 10) & (texts.buf != 13), texts.offs)
    space = (texts.buf == 32) | (texts.buf == 9)
    solid = np.zeros(len(texts.buf) + 1, np.int64)
    np.cumsum(~space, out=solid[1:])
    places = np.flatnonzero(~space)
    keep = solid[end] > solid[start]
    row, start, end = row[keep], start[keep], end[keep]
    start, end = places[solid[start]] if len(places) else start, places[solid[end] - 1] + 1 if len(places) else end
    return Pieces(row, start, end, _hash(texts.buf.astype(U64) + U64(1), start, end))


def sentences(texts: Texts) -> Pieces:
    """Runs between sentence ends (. ! ?) and line ends that hold at least one word byte."""
    b = texts.buf
    inside = ~((b == 46) | (b == 33) | (b == 63) | (b == 10) | (b == 13))
    row, start, end = _runs(inside, texts.offs)
    codes = _WORD[b]
    there = np.zeros(len(b) + 1, np.int64)
    np.cumsum(codes != 0, out=there[1:])
    keep = there[end] > there[start]
    row, start, end = row[keep], start[keep], end[keep]
    places = np.flatnonzero(codes)
    start, end = (places[there[start]], places[there[end] - 1] + 1) if len(places) else (start, end)
    return Pieces(row, start, end, _hash(codes.astype(U64), start, end))


def shingles(w: Pieces, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `k` successive words of one row: index of its first word, and hash."""
    m = len(w.row) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = w.row[:m] == w.row[k - 1 :]
    with np.errstate(over="ignore"):
        h = w.hash[:m].copy()
        for i in range(1, k):
            h *= U64(_BASE)
            h ^= h >> U64(29)
            h += w.hash[i : m + i]
    at = np.flatnonzero(inside)
    return at, mix64(h[at])


def distinct_per_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), ordered by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[keep], value[keep]
    return row, value


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's entries begin in an array ordered by row."""
    return np.searchsorted(row, np.arange(rows + 1))
