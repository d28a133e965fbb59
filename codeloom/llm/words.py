"""Vectorised word segmentation and hashing over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole batch at once; no Python
object is made for a word. Word hashes are 64-bit polynomial hashes finished by
a mixing step, the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = U(0xD6E8FEB86659FD93)
CHUNK = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Everything in ASCII but letters and digits; bytes of other scripts are part of words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK * 2)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, U(base & (2**64 - 1)), U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some rows. ``first[i]:first[i + 1]`` are those of row i; starts and ends are byte offsets into the row's text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word sequences, and of which word each begins at; none crosses rows."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        g = self.hash[:n].copy()
        for j in range(1, k):
            g = g * _GRAM + self.hash[j : n + j]
        row = self.rows()
        at = np.flatnonzero(row[:n] == row[k - 1 :])
        return mix(g[at]), at


def segment(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Words of the rows whose bytes are ``data[offsets[i]:offsets[i + 1]]``."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    n = len(data)
    if not n:
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~separators[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    opens[bounds] = inside[bounds]
    closes = np.zeros(n + 1, bool)
    closes[1:] = inside[:-1] & ~inside[1:]
    closes[bounds] = inside[bounds - 1]
    start, end = np.flatnonzero(opens[:n]), np.flatnonzero(closes)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((fold[data].astype(U) + U(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    first = np.searchsorted(start, offsets)
    origin = np.repeat(offsets[:-1], np.diff(first))
    return Words(hashes, start - origin, end - origin, first)


def spaced(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with marks beyond ASCII as spaces: those of U+00A0 to U+00BF but letters, U+2000 to U+206F, U+3000 to U+3003, and fullwidth ones of U+FF00 to U+FF0F."""
    data = data.copy()
    c2 = np.flatnonzero(data[:-1] == 0xC2)
    c2 = c2[~np.isin(data[c2 + 1], (0xAA, 0xB5, 0xBA))]
    data[c2], data[c2 + 1] = 32, 32
    for first, second, lo, hi in ((0xE2, 0x80, 0x80, 0xBF), (0xE2, 0x81, 0x80, 0xAF), (0xE3, 0x80, 0x80, 0x83), (0xEF, 0xBC, 0x80, 0x8F)):
        at = np.flatnonzero(data[:-2] == first)
        at = at[(data[at + 1] == second) & (data[at + 2] >= lo) & (data[at + 2] <= hi)]
        for i in range(3):
            data[at + i] = 32
    return data


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``size`` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges begin[i]:end[i], one after another."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held and _last(held, key) != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.argmax(keys == keys[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _last(held: list[pa.RecordBatch], key: str) -> object:
    column = held[-1].column(held[-1].schema.get_field_index(key))
    return column[len(column) - 1].as_py()
