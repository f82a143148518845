"""Words, lines and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. As these bytes never are part of a longer
UTF-8 sequence, such runs are the words of the text itself. Hashes have 64 bits: a random value for
each byte, a polynomial over them, then a finalizer with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of x over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def by_doc(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A key that is equal only for equal keys of the same document."""
    return mix(key ^ mix(doc.astype(np.uint64) + U(0x1234567)))


class Texts:
    """Texts, each followed by a line feed of ours, in one array of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n = n = len(offsets) - 1
        size = np.diff(offsets)
        self.start = offsets[:-1] - offsets[0] + np.arange(n)  # of each text in buf
        self.size = size
        self.end = self.start + size  # where our line feed stands
        keep = np.ones(int(size.sum()) + n, bool)
        keep[self.end] = False
        self.buf = np.full(len(keep), 10, np.uint8)
        raw = data[offsets[0] : offsets[-1]]
        self.buf[keep] = LOWER[raw] if lower else raw
        self._sums: np.ndarray | None = None

    def total(self, flags: np.ndarray) -> np.ndarray:
        """The sum of the flags of each text's bytes, our line feed's included."""
        return np.add.reduceat(flags, self.start, dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of buf[start:end], for each pair."""
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_BYTES[self.buf] * powers(_INVERSE, len(self.buf)), out=self._sums[1:])
        p = powers(_BASE, len(self.buf) + 1)
        return mix((self._sums[end] - self._sums[start]) * p[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and end of each word."""
        gap = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        s, e = edge[::2], edge[1::2]
        return np.searchsorted(self.start, s, "right") - 1, s, e

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and end of each line: what split("\\n") gives."""
        e = np.flatnonzero(self.buf == 10)
        s = np.empty_like(e)
        if len(e):
            s[0], s[1:] = 0, e[:-1] + 1
        return np.searchsorted(self.start, s, "right") - 1, s, e


def ngrams(doc: np.ndarray, word: np.ndarray, n: int, n_docs: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each run of n words in a document, in order. short: a document of fewer
    words has them all as its only one, after the others."""
    if not len(word):
        return doc[:0], word[:0]
    m = len(word) - n + 1
    total = np.zeros(max(m, 0), np.uint64)
    for j in range(n):
        total += word[j : j + m] * _FACTORS[j] if m > 0 else U(0)
    inside = doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)
    d, h = doc[:m][inside] if m > 0 else doc[:0], mix(total[inside])
    if short and n > 1:
        count = np.bincount(doc, minlength=n_docs)
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            first = np.searchsorted(doc, few)
            s = count[few].astype(np.uint64) * U(0xA0761D6478BD642F)
            for j in range(n - 1):
                at = first + j
                s += np.where(j < count[few], word[np.minimum(at, len(word) - 1)] * _FACTORS[j], U(0))
            d, h = np.concatenate([d, few]), np.concatenate([h, mix(s)])
    return d, h


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, null as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    arr = arr.cast(pa.large_binary())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def pieces(batch: pa.RecordBatch, name: str, limit: int = 1 << 20, lower: bool = False) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts, each of about limit bytes (a longer text is a run of its own), as first
    and last+1 row and Texts."""
    data, offsets = column(batch, name)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, Texts(data, offsets[i : j + 1], lower)
        i = j
