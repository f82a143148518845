"""Periodic runs of words by an online sparse diagonal dynamic programme.

Every word meets earlier occurrences of itself; each is a lag, and a lag that the word before had too has
its match length increased by one. Where a lag is not met again its diagonal ends: with L matches at lag q
the L + q words up to there have period q, and if they are max(LEAST, POWER * q) at least they are a run,
emitted at once. All words of a batch take the step together.

What keeps it sparse: a common word has many earlier occurrences, but few of them can belong to a run. In a
run of smallest period q, any k >= q consecutive words last occurred exactly q words before: an occurrence
nearer than q would give the run a smaller period. So at each scale k = 16, 32, 64, ... only the latest
earlier occurrence of the k words that begin here is a lag, and it counts if it is in (k/2, k]; diagonals
found so are whole, and their lag is the smallest period. Words whose k words occur just once in the
document drop out of all larger scales. Lags up to 8 have their diagonals followed word by word, those of a
multiple of a smaller period are left out. The work is O(n) for each scale, of which there are log2(n), also
for a text of one word repeated.

Documents are independent, so nothing is shuffled: one pass over the texts, in bounded batches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, bounded, enter
from .textvec import Texts, by_doc, mix, pieces, powers

#: A run has this many words, and this many times its period, at least.
LEAST, POWER = 6, 4
#: Lags up to here are followed word by word, longer ones by scales of twice the size each.
NEAR = 8
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 place of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return edge[::2], edge[1::2]


def _near(doc: np.ndarray, word: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """First word, length and lag of the runs at lags up to NEAR."""
    for q in range(1, min(NEAR, len(word) - 1) + 1):
        first, end = _stretches((word[q:] == word[:-q]) & (doc[q:] == doc[:-q]))
        ok = end - first + q >= max(least, power * q)
        first, end = first[ok], end[ok]
        for p in (p for p in range(1, q) if q % p == 0 and len(first)):
            # period p as well: the first q matches tell, the rest repeats them
            smaller = np.all([word[first + j] == word[first + j + p] for j in range(q)], axis=0)
            first, end = first[~smaller], end[~smaller]
        yield first, end - first + q, q


def _far(doc: np.ndarray, word: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First word, length and lag of the runs at longer lags, scale by scale."""
    n, k = len(word), 2 * NEAR
    if n < power * (NEAR + 1):
        return
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(word) * powers(_BACK, n), out=sums[1:])
    base = powers(_BASE, n)
    last = np.flatnonzero(np.diff(doc, append=-1))  # of each document
    end = last[np.searchsorted(last, np.arange(n))] + 1  # of each word's document
    at = np.arange(n)
    while True:
        at = at[at + k <= end[at]]
        if len(at) < 2:
            return
        key = by_doc(doc[at], mix((sums[at + k] - sums[at]) * base[at]))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
        hit = (lag > k // 2) & (lag <= k)
        i, q = at[hit], lag[hit]
        if len(i):
            # a diagonal goes on where the next word has the same lag
            new = np.flatnonzero((np.diff(i, prepend=-2) != 1) | (np.diff(q, prepend=-1) != 0))
            i, q, length = i[new], q[new], np.diff(np.append(new, len(i))) + k - 1 + q[new]
            ok = length >= np.maximum(least, power * q)
            yield i[ok] - q[ok], length[ok], q[ok]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = at[again]
        k *= 2


def find_runs(doc: np.ndarray, word: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (place in the arrays), length and period of every run, by first word, then period.
    doc: of each word, in order; word: its hash. power must be 3 at least, or scales could miss runs."""
    if power < 3:
        raise ValueError("power must be 3 at least")
    found = [*_near(doc, word, least, power), *_far(doc, word, least, power)]
    first = np.concatenate([np.zeros(0, np.int64), *[f for f, _, _ in found]])
    length = np.concatenate([np.zeros(0, np.int64), *[n for _, n, _ in found]])
    period = np.concatenate([np.zeros(0, np.int64), *[np.broadcast_to(q, f.shape) for f, _, q in found]])
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


class _Read:
    """A piece of texts with its runs: the words in reading order, and which of them stay."""

    def __init__(self, t: Texts, order: Callable[[np.ndarray], np.ndarray] | None, least: int, power: int):
        doc, s, e = t.words()
        self.begin = np.searchsorted(doc, np.arange(t.n + 1))  # of each text's words
        if order is not None:
            at = order(self.begin)
            s, e = s[at], e[at]
        self.t, self.s, self.e = t, s, e
        self.first, self.length, self.period = find_runs(doc, t.hashes(s, e), least, power)
        self.runs = np.searchsorted(self.first, self.begin)  # of each text's runs

    def kept(self) -> tuple[bytes, np.ndarray]:
        """The words that no run has after its first period, a space after each, and where each text's begin."""
        depth = np.zeros(len(self.s) + 1, np.int64)
        np.add.at(depth, self.first + self.period, 1)
        np.add.at(depth, self.first + self.length, -1)
        stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        size = self.e[stay] - self.s[stay] + 1
        end = np.cumsum(size)
        place = np.repeat(self.s[stay] - end + size, size) + np.arange(size.sum())
        out = self.t.buf[np.minimum(place, len(self.t.buf) - 1)] if len(place) else np.zeros(0, np.uint8)
        out[end - 1] = 32
        return out.tobytes(), np.append(0, end)[np.searchsorted(stay, self.begin)]

    def collapsed(self) -> Iterator[bytes]:
        body, at = self.kept()
        for x, y in zip(at[:-1], at[1:], strict=True):
            yield body[x : max(x, y - 1)]


def _lists(offsets: list[np.ndarray], values: list[tuple[np.ndarray, ...]]) -> pa.Array:
    flat = [np.concatenate([np.zeros(0, np.int64), *[v[c] for v in values]]) for c in range(3)]
    sizes = np.concatenate([np.zeros(0, np.int64), *offsets])
    items = pa.StructArray.from_arrays([pa.array(v) for v in flat], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), items)


def runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words and runs (array of start, length, period, by start and period; places are word
    numbers from 0) of each row of docs.

    A null or empty text has no words and no runs. Rows are independent: repeated rows, null ids and other
    columns don't matter; no rows give none.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words, counts, values = [], [], []
        for _, _, t in pieces(b, "text"):
            r = _Read(t, None, least, power)
            words.append(np.diff(r.begin))
            counts.append(np.diff(r.runs))
            values.append((r.first - np.repeat(r.begin[:-1], counts[-1]), r.length, r.period))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(words)), _lists(counts, values)], ["doc_id", "n_words", "runs"])

    return arrow_map(docs, ["doc_id", "text"], run, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>", "runs")


def collapse(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """docs with one period left of every run in text: the words that no run has after its first period,
    joined by single spaces. Texts without a run stay byte for byte.

    Null and empty texts stay, as do all rows and other columns; repeated rows are treated alike; no rows
    give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("runs")
        for b in batches:
            if not b.num_rows:
                continue
            k = b.schema.get_field_index("text")
            texts = b.column(k)
            out = texts.to_pylist()
            for i, _, t in pieces(b, "text"):
                r = _Read(t, None, least, power)
                if len(r.first):
                    for j, (text, n) in enumerate(zip(r.collapsed(), np.diff(r.runs), strict=True)):
                        if n:
                            out[i + j] = text.decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if j == k else c for j, c in enumerate(b.columns)], b.schema.names)

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]))


def planted(ids: list[int | None], begin: np.ndarray) -> np.ndarray:
    """The words' places in reading order where documents are made periodic: with h the CRC-32 of the
    decimal id and g = h div 10, one in ten (h mod 10 = 0) repeats from word a = g mod n on its p = 1 + (n -
    a) div (3 + g mod 8) words from there. A null id plants nothing."""
    at = np.arange(begin[-1])
    for i, key in enumerate(ids):
        n = int(begin[i + 1] - begin[i])
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[begin[i] + a : begin[i + 1]] = begin[i] + a + np.arange(n - a) % p
    return at


def run_digests(docs: DataFrame, plant: bool = False, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties by start, then period;
    four nulls without a run), and SHA-256 of the list of runs and of the collapsed words, of each row of docs.

    plant makes one document in ten periodic first, see planted(). A null or empty text has no runs and the
    digests of nothing. Rows are independent: repeated rows, null ids and other columns don't matter; no rows
    give none.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_pylist()
        n_runs, best, lists, texts = [], [], [], []
        for i, j, t in pieces(b, "text"):
            r = _Read(t, (lambda begin, of=ids[i:j]: planted(of, begin)) if plant else None, least, power)
            start = r.first - np.repeat(r.begin[:-1], np.diff(r.runs))
            for x, y in zip(r.runs[:-1], r.runs[1:], strict=True):
                mine = list(zip(start[x:y].tolist(), r.length[x:y].tolist(), r.period[x:y].tolist(), strict=True))
                n_runs.append(len(mine))
                top = min(mine, key=lambda m: (-m[1], m[0], m[2]), default=None)
                best.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
                lists.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in mine).encode()).hexdigest())
            texts += [hashlib.sha256(x).hexdigest() for x in r.collapsed()]
        columns = [pa.array([x[c] for x in best], pa.int64()) for c in range(4)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_runs, pa.int64()), *columns, pa.array(lists, pa.string()), pa.array(texts, pa.string())], names)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return arrow_map(docs, ["doc_id", "text"], run, schema, "runs")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
