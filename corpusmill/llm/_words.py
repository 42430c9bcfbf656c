"""Vectorised word and window hashing over Arrow text columns.

A word is a run of ASCII letters and digits (A-Z lower-cased) or of any code points from U+0080 on, so words can be found on
UTF-8 bytes. A word's hash is the sum of scrambled (byte, place in the word) codes, so that no pattern in long words makes
two of them alike. One 64-bit hash selects candidates; where a hash stands for a run of words itself, a second one beside it
(wide) makes 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone and whole.
CHUNK_BYTES = 1 << 18

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9D8A6F4C3B21E7F5  # odd, so its powers can be undone modulo 2**64
_STEP = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd base modulo 2**64, and their inverses: hashes of byte runs from running sums."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of some consecutive texts. row counts from the first of these texts; first[r]..first[r+1] are the words of row r."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    more: np.ndarray | None = None  # a second hash

    @property
    def n_rows(self) -> int:
        return len(self.first) - 1

    def text(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1, joined by a space."""
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(i, i + n))

    def windows(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word, and hash (second: the other hash), of every run of n words within one text."""
        hashes = self.more if second else self.hash
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total += hashes[k : k + len(total)] * np.uint64(pow(_STEP, k, 1 << 64))
        return at, mix64(total[at])

    def whole(self, row: int, second: bool = False) -> np.uint64:
        """Hash of all words of one text as a single window."""
        part = (self.more if second else self.hash)[self.first[row] : self.first[row + 1]]
        factors = np.full(len(part), _STEP, np.uint64)
        factors[0] = 1
        return mix64(np.array([(part * np.multiply.accumulate(factors)).sum(dtype=np.uint64)], np.uint64))[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row begins; a null row is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of up to limit bytes each, one row at least."""
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, stop
        row = stop


def find_words(data: np.ndarray, at: np.ndarray, wide: bool = False) -> Words:
    """Words of the texts whose bytes are data[at[0]:at[1]], data[at[1]:at[2]] and so on."""
    raw, edges = _LOWER[data[at[0] : at[-1]]], at - at[0]
    inside = _IS_WORD[raw]
    opens, closes = inside.copy(), inside.copy()
    if len(raw):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        own = edges[:-1][np.diff(edges) > 0]
        opens[own] = inside[own]
        last = edges[1:][np.diff(edges) > 0] - 1
        closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    place = np.arange(len(raw), dtype=np.uint64)
    place[inside] -= np.repeat(start, end - start).astype(np.uint64)
    codes = mix64(raw + (place << np.uint64(8)) + np.uint64(_BASE))
    first = np.searchsorted(start, edges)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(raw, start, end, row, first, _sums(codes, start, end), _sums((codes ^ (codes >> np.uint64(29))) * np.uint64(_STEP), start, end) if wide else None)


def _sums(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    return mix64(sums[end] - sums[start])


def each_words(column: pa.Array, wide: bool = False) -> Iterator[tuple[int, Words]]:
    """Words of a column, a bounded number of bytes at a time, each with the row it begins at."""
    data, at = buffers(column)
    for row, stop in chunks(at):
        yield row, find_words(data, at[row : stop + 1], wide)
