"""Chunks of text on the largest units that fit: paragraphs, sentences, clauses, words.

A text is cut into splits: a paragraph is one if it has `size` tokens at most, else its sentences are, of these
the longer ones by clauses, and those by tokens. Chunks take whole splits as long as they fit, and begin with
as many of the last splits of the chunk before as `overlap` tokens allow and leave room for the next split. A
token is what stands between white space (space, tab, line feed, vertical tab, form feed, carriage return).

A batch of texts is cut at once: levels of boundaries, sizes of units and sums of tokens are arrays over the
batch's bytes, and a chunk's end is looked up in the sums; only the walk from chunk to chunk is a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ENDS, _PAUSES, _CLOSERS = np.frombuffer(b".!?", np.uint8), np.frombuffer(b",;:", np.uint8), np.frombuffer(b"\"')]", np.uint8)
#: Ends of sentences and clauses beyond ASCII, as their three bytes: full stop, question, exclamation and ellipsis; commas.
_WIDE_ENDS, _WIDE_PAUSES = ("。", "？", "！", "…"), ("，", "；", "、")
CHUNK = "doc_id long, chunk_index int, first_token long, begin long, stop long, raw_text string, token_count int"


def _wide(marks: tuple[str, ...]) -> np.ndarray:
    return np.array([int.from_bytes(m.encode(), "big") for m in marks])


def _levels(buf: np.ndarray, end: np.ndarray, gap_end: np.ndarray, separator: bytes) -> np.ndarray:
    """Of the boundary after each token: 3 a paragraph's, 2 a sentence's, 1 a clause's, 0 none of these."""
    last = end - 1
    for _ in range(3):  # quotes and brackets after a full stop belong to its sentence
        back = np.maximum(last - 1, 0)
        last = np.where(np.isin(buf[last], _CLOSERS) & (last > 0) & ~_SPACE[buf[back]], back, last)
    tail = buf[last].astype(np.int64)
    wide = np.where(last >= 2, (buf[last - 2].astype(np.int64) << 16) | (buf[last - 1].astype(np.int64) << 8) | tail, 0)
    level = np.where(np.isin(tail, _PAUSES) | np.isin(wide, _wide(_WIDE_PAUSES)), 1, 0)
    level = np.where(np.isin(tail, _ENDS) | np.isin(wide, _wide(_WIDE_ENDS)), 2, level)
    mark = np.frombuffer(separator, np.uint8)
    hits = np.ones(max(0, len(buf) - len(mark) + 1), bool)
    for k, m in enumerate(mark):
        hits &= buf[k : k + len(hits)] == m
    upto = np.append(0, np.cumsum(hits))
    room = np.maximum(gap_end - len(mark) + 1, end)
    return np.where(upto[np.minimum(room, len(hits))] > upto[np.minimum(end, len(hits))], 3, level)


def _splits(doc: np.ndarray, level: np.ndarray, size: int) -> np.ndarray:
    """Whether a split ends after each token."""
    last = np.append(doc[1:] != doc[:-1], True)
    cut = last.copy()
    inside = np.ones(len(doc), bool)  # tokens of units that are still too large
    for least in (3, 2, 1):
        ends = last | (level >= least)
        unit = np.cumsum(np.append(0, ends[:-1]))
        cut |= inside & ends
        inside &= (np.bincount(unit) > size)[unit]
    return cut | inside


def _chunks(splits: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First and last+1 split of each chunk of one text. splits: tokens up to each split, 0 first."""
    a, n = 0, len(splits) - 1
    while True:
        b = int(np.searchsorted(splits, splits[a] + size, "right")) - 1
        yield a, b
        if b >= n:
            return
        a = max(a, int(np.searchsorted(splits, splits[b] - overlap)), int(np.searchsorted(splits, splits[b + 1] - size)))


def _cut(batch: pa.RecordBatch, size: int, overlap: int, separator: bytes) -> pa.RecordBatch:
    texts = batch.column(1).fill_null("").cast(pa.large_binary())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # a space of ours after each text, so that no token crosses two
    n = batch.num_rows
    begin, stop = offsets[:-1] + np.arange(n), offsets[1:] + np.arange(n)
    keep = np.ones(len(raw) + n, bool)
    keep[stop] = False
    buf = np.full(len(keep), 32, np.uint8)
    buf[keep] = raw
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True))
    s, e = edge[::2], edge[1::2]
    doc = np.searchsorted(begin, s, "right") - 1
    rows: list[list] = [[] for _ in range(7)]
    if len(s):
        gap_end = np.minimum(np.append(s[1:], len(buf)), stop[doc])
        ends = np.flatnonzero(_splits(doc, _levels(buf, e, gap_end, separator), size)) + 1
        first = np.searchsorted(doc, np.arange(n + 1))
        where = np.searchsorted(ends, first, "right")
        view = memoryview(buf)
        for d in np.unique(doc).tolist():
            sums = np.append(0, ends[where[d] : where[d + 1]] - first[d])
            for k, (a, b) in enumerate(_chunks(sums, size, overlap)):
                x, y = int(sums[a]), int(sums[b])
                i, j = int(s[first[d] + x]), int(e[first[d] + y - 1])
                for to, v in zip(rows, (d, k, x, i - int(begin[d]), j - int(begin[d]), bytes(view[i:j]).decode(), y - x), strict=True):
                    to.append(v)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
    ids = batch.column(0).take(pa.array(rows[0], pa.int64())).cast(pa.int64())
    return pa.RecordBatch.from_arrays([ids, *[pa.array(v, t) for v, t in zip(rows[1:], kinds, strict=True)]], ["doc_id", "chunk_index", "first_token", "begin", "stop", "raw_text", "token_count"])


def split_text(docs: DataFrame, size: int = 1000, overlap: int = 200, separator: str = "\n\n", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index, first_token (its number in the text), begin and stop (bytes of the text), raw_text (those
    bytes: it neither begins nor ends with white space) and token_count of the chunks of each row of docs.

    No chunk has more than size tokens, chunks overlap by overlap tokens at most, and together they have all
    tokens in order. A null or empty text, or one of white space, has no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _cut(b, size, overlap, separator.encode())

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, CHUNK)
