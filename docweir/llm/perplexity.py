"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted documents are those labelled good. Half of them, by a hash of their id, trains the model and
all others set the thresholds, so both grow with the input. The discounts of each order come from its counts of counts.

A text's logarithm of probability is a sum: what every word gets that was never seen, and a value for each of its
words, contexts, bigrams and trigrams that the model knows, a known n-gram's being what it is above its back-off. So
each n-gram is looked up for itself and nothing but sums comes back.

N-grams go to shards by hash, as records of which many are a row of bytes, and meet there: trigrams with their first two
words for the context's total and back-off weight, then with their last two for the rest. A bigram and the trigram
that ends with it lie in one shard and are asked together; its value holds its weight as the next word's context.
Values of at most FREQUENT words are known to every task, those of all others are sent to where they are wanted.
The model is built in slices by its trigrams' middle word, and a part of the documents asks a slice at a time, so that
no more than a slice and a round's keys lie on disk. A hot n-gram is one entry; a task's copies of a trigram
are one record with their number, and a shard's keys are taken block by block.
A document is kept when
its perplexity is within the QUANTILE of the trusted documents of its language that the model wasn't
trained on. Languages with fewer than INSIDE / (1 - quantile) of these, among which the quantile would
be one of the INSIDE worst documents or the worst itself, take the quantile of all.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cache, durable, forget, tidy
from .textvec import U, Texts, mix, pieces

QUANTILE, INSIDE = 0.99, 5

_START = U(0x5851F42D4C957F2D)
_F = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
#: Slices of the model and rounds of texts for each, from SLICE_BYTES of text for each slice on; fewer for less.
SLICES, ROUNDS, SLICE_BYTES = 3, 3, 16 << 20
#: Entries of a shard, bytes of text for each (by slice), and keys in a task before they go out.
SHARD, SHARD_BYTES, PACK, SEED = 500_000, 8 << 20, 1_000_000, 20240607
#: Words whose values every task knows, and the places of their table.
FREQUENT, PLACES = 1 << 18, 1 << 20

_TOKEN = np.dtype([("a", "u8"), ("v", "u8"), ("w", "u8"), ("n", "u4")])
_TRIGRAM = np.dtype([("k3", "u8"), ("v", "u8"), ("w", "u8"), ("share", "f8"), ("back", "f8")])
_CONTEXT = np.dtype([("key", "u8"), ("b", "f8")])
_WORD = np.dtype([("key", "u8"), ("p", "f8"), ("b", "f8"), ("total", "f8")])
_WANTED = np.dtype([("key", "u8"), ("shard", "u4")])
#: Entries: what an n-gram adds, and what of it is its weight as the next word's context.
_ENTRY, _GAIN = np.dtype([("key", "u8"), ("gain", "f8"), ("b", "f8")]), np.dtype([("key", "u8"), ("gain", "f8")])
WORD_COLUMNS = ("a", "v", "w", "k3")
_ROW = "shard int, kind int, data binary"
#: Kinds of rows that meet in a shard of the model.
TRIGRAMS, CONTEXTS, SENT, OWN = range(4)
#: Kinds of keys that a batch asks: bigrams with trigrams, words, and what has no next word; and what it knows itself.
PAIRS, WORDS, LAST_WORDS, LAST_PAIRS, KNOWN = range(5)
#: Bytes of text that are cut into words at once: their arrays stay in a core's cache.
CUT = 1 << 18


def trigrams(t: Texts) -> tuple[np.ndarray, ...]:
    """Document, and first, middle and last word of the trigram, for every word in order; two start marks
    come before a document's first word."""
    doc, s, e = t.words()
    w = t.hashes(s, e)
    first = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
    b = np.concatenate([w[:1], w[:-1]])
    b[first] = _START
    a = np.concatenate([b[:1], b[:-1]])
    a[first] = _START
    return doc, a, b, w


def _two(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _F[0] + w * _F[1])


def _three(a: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(a * _F[0] + v * _F[1] + w * _F[2])


def _slice(word: np.ndarray, slices: int) -> np.ndarray:
    return (word >> U(33)) % U(slices)


def _slices(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(SLICES, 1 + size // SLICE_BYTES)


def _shards(texts: DataFrame, slices: int, size: int = 0) -> int:
    """Shards of a slice, for texts and a model of size entries."""
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, n // SHARD_BYTES // slices, size // slices // SHARD)


@contextlib.contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of each query go as it ends: what is wanted of it is a durable table by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Frequent:
    """A table of words with one place for each: of those that share it, the most frequent has it."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.key, self.value = words["key"].copy(), words["p"] + words["b"]
        self.place = np.full(PLACES, -1, np.int32)
        self.place[(words["key"] & U(PLACES - 1))[::-1].astype(np.int64)] = np.arange(len(words), dtype=np.int32)[::-1]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word is in the table, and its row."""
        if not len(self.words):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int32)
        row = self.place[(key & U(PLACES - 1)).astype(np.int64)]
        return self.key[row] == key, row


@dataclass
class Model:
    """What all slices of a model share: the trusted texts, the discounts of three and two words, the words
    (w, p1 the logarithm of their probability, b1 that of their weight as a context and its total), the
    frequent ones of them, and the logarithm for a word that was never seen."""

    texts: DataFrame
    d3: tuple[float, float, float]
    d2: tuple[float, float, float]
    words: DataFrame
    frequent: Broadcast
    base: float
    size: int


def _frequent(b: Broadcast) -> Frequent:
    """The table of frequent words, made once in a worker."""
    name, words = b.value
    kept = cache("perplexity")
    if kept.get("name") != name:
        kept.update(name=name, table=Frequent(words))
    return kept["table"]


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice, and more often, from how many were seen one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    each = [k - (k + 1) * y * (m / n if n else 0) for k, n, m in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(np.clip(d, 0.05, k - 0.05)) for k, d in zip((1, 2, 3), each, strict=True))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key & U(0xFFFFFFFF)) % U(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)


def _dealt(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of what goes there, in their order."""
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for i in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(i), order[(ends[i - 1] if i else 0) : ends[i]]


def _column(x: np.ndarray, name: str) -> bytes:
    """A column's bytes, so that they compress. Words stand as they are, those that repeat being found as such; of
    keys, which are sorted where they are many, the differences; and the first byte of every value before the second of any."""
    if name in WORD_COLUMNS:
        return x.tobytes()
    if name == "key":
        x = np.diff(x, prepend=U(0))
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _values(data: np.ndarray, dtype: np.dtype, name: str) -> np.ndarray:
    if name in WORD_COLUMNS:
        return data.view(dtype)
    x = data.reshape(dtype.itemsize, -1).T.copy().view(dtype)[:, 0]
    return np.cumsum(x, dtype=np.uint64) if name == "key" else x


def _packed(records: np.ndarray) -> bytes:
    return b"".join(_column(records[n], n) for n in records.dtype.names)


def _unpacked(data: pa.Scalar, dtype: np.dtype) -> np.ndarray:
    data = np.frombuffer(data.as_buffer(), np.uint8)
    out, at = np.empty(len(data) // dtype.itemsize, dtype), 0
    for n in dtype.names:
        size = len(out) * dtype[n].itemsize
        out[n] = _values(data[at : at + size], dtype[n], n)
        at += size
    return out


def _rows(kind: int, records: np.ndarray, shard: np.ndarray, shards: int) -> list[tuple[int, int, bytes]]:
    return [(s, kind, _packed(records[i])) for s, i in _dealt(shard, shards)]


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])


_BYTES_ROW = [("shard", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]


def _records(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    """All records of a kind among the rows of a shard."""
    got = [_unpacked(d, dtype) for k, d in zip(table.column("kind").to_numpy(), table.column("data"), strict=True) if k == kind]
    return np.concatenate(got) if got else np.zeros(0, dtype)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts keys, where in it each key begins, and how many there are of each."""
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order, begin, np.diff(begin, append=len(key))


def _once(tokens: np.ndarray) -> np.ndarray:
    """Each trigram once, with how often it was there."""
    order, begin, _ = _groups(_three(tokens["a"], tokens["v"], tokens["w"]))
    out = tokens[order[begin]]
    out["n"] = np.add.reduceat(tokens["n"][order], begin) if len(begin) else 0
    return out


def _distinct(wanted: np.ndarray) -> np.ndarray:
    """Each pair of a word and a shard once."""
    wanted = wanted[np.lexsort((wanted["shard"], wanted["key"]))]
    return wanted[np.concatenate([[True], (np.diff(wanted["key"]) != 0) | (np.diff(wanted["shard"]) != 0)])] if len(wanted) else wanted


def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return n - np.array(d)[np.minimum(n, 3).astype(np.int64) - 1]


def _tokens(texts: DataFrame, f: Callable[[np.ndarray], list[tuple]], want: Callable[[np.ndarray, np.ndarray], np.ndarray], once: bool = True) -> DataFrame:
    """Rows of bytes that f makes of a task's trigrams, PACK at a time, of those whose first and middle word are wanted;
    each of them once, by middle word, or all as they come."""

    def run(batches):
        parts, n = [], 0

        def pack():
            tokens = np.ones(n, _TOKEN)
            for i, name in enumerate("avw"):
                tokens[name] = np.concatenate([p[i] for p in parts])
            if once:
                tokens = _once(tokens)
                tokens = tokens[np.argsort(tokens["v"])]
            return _batch(f(tokens), _BYTES_ROW)

        for b in batches:
            for _, _, t in pieces(b, "text", CUT, lower=True):
                _, *avw = trigrams(t)
                here = want(avw[0], avw[1])
                parts.append([x[here] for x in avw])
                n += len(parts[-1][0])
                if n >= PACK:
                    yield pack()
                    parts, n = [], 0
        if n:
            yield pack()

    bounded(texts.sparkSession)
    return texts.select("text").mapInArrow(tidy(run, "perplexity"), _ROW)


def _counted(table: pa.Table) -> pa.Table:
    """Of the trigrams of a shard: how many trigrams and bigrams (kind 3 and 2) there are one to four times, and
    for each word (kind 1) the bigrams that it ends (n) and, as their first word, their total and how many of them
    are there once, twice and more often."""
    tokens = _once(_records(table, TRIGRAMS, _TOKEN))
    order, begin, n2 = _groups(_two(tokens["v"], tokens["w"]))
    two = tokens[order[begin]]
    rows = [np.array([[k, 0, *np.bincount(np.minimum(n, 5), minlength=6)[1:5], 0]]) for k, n in ((3, tokens["n"].astype(np.int64)), (2, n2))]
    w, n = np.unique(two["w"], return_counts=True)
    none = np.zeros_like(n)
    rows.append(np.stack([none + 1, w.view(np.int64), n, none, none, none, none], 1))
    v, at = np.unique(two["v"], return_inverse=True)
    sums = [np.bincount(at, x, minlength=len(v)).astype(np.int64) for x in (n2, n2 == 1, n2 == 2, n2 > 2)]
    rows.append(np.stack([np.ones(len(v), np.int64), v.view(np.int64), np.zeros(len(v), np.int64), *sums], 1))
    return pa.table(dict(zip(("kind", "w", "n", "total", "ones", "twos", "rest"), np.concatenate(rows).T.copy(), strict=True)))


def model(texts: DataFrame, slices: int | None = None) -> Model:
    """The model of texts (text): a pass over their trigrams, slice by slice of the middle word, for the
    counts of counts of each order and the words."""
    spark = texts.sparkSession
    with _brief_shuffles(spark):
        texts = durable(texts.select("text"), "trusted")
        slices = slices or _slices(texts)
        shards = _shards(texts, slices)
        tables = []
        for part in range(slices):
            deal = lambda t: _rows(TRIGRAMS, t, _shard(_two(t["v"], t["w"]), shards), shards)
            tokens = _tokens(texts, deal, lambda a, v, part=part: _slice(v, slices) == part)
            names = ("kind", "w", "n", "total", "ones", "twos", "rest")
            tables.append(durable(tokens.groupBy("shard").applyInArrow(_counted, ", ".join(f"{n} long" for n in names)), "words"))
        every = reduce(DataFrame.union, tables)
        # of kind 3 and 2 the columns from n on are how many are there one to four times
        many = {r.kind: [float(x) for x in r[1:]] for r in every.where("kind > 1").groupBy("kind").agg(F.sum("n"), F.sum("total"), F.sum("ones"), F.sum("twos")).collect()}
        one = every.where("kind = 1").groupBy("w").agg(*[F.sum(c).alias(c) for c in names[2:]])
        one = durable(one, "word-counts")
        seen = one.where("n > 0").agg(*[F.sum((F.col("n") == k).cast("long")) for k in range(1, 5)], F.sum("n"), F.count("*")).first()
        d3, d2 = (_discounts(*many.get(k, [0.0] * 4)) for k in (3, 2))
        d1 = _discounts(*(float(x or 0) for x in seen[:4]))
        ones, twos, known = float(seen[0] or 0), float(seen[1] or 0), int(seen[5])
        total, left = float(seen[4] or 1), ones * d1[0] + twos * d1[1] + (known - ones - twos) * d1[2] if known else 1.0
        base = left / total / (known + 1)  # what a word that was never seen gets
        less = lambda d: F.col("n") - F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        p1 = F.when(F.col("n") > 0, F.log(less(d1) / total + base)).otherwise(float(np.log(base)))
        b1 = F.when(F.col("total") > 0, F.log((F.col("ones") * d2[0] + F.col("twos") * d2[1] + F.col("rest") * d2[2]) / F.col("total"))).otherwise(0.0)
        words = durable(one.select("w", p1.alias("p1"), b1.alias("b1"), F.col("total").cast("double").alias("total"), (F.col("n") + F.col("total")).alias("seen")), "word-probabilities")
        for t in [*tables, one]:
            forget(t)
        size = 2 * known + sum(int(x) for k in many.values() for x in k)
        return Model(texts, d3, d2, words, _most_frequent(words), float(np.log(base)), size)


def _most_frequent(words: DataFrame) -> Broadcast:
    """The words above the least number of n-grams that no more than FREQUENT exceed, the most frequent first."""
    level = F.floor(16 * F.log2("seen"))
    n, least = 0, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        n += r["count"]
        if n > FREQUENT:
            break
        least = r["level"]
    got = words.where(level >= least).toArrow() if least is not None else words.limit(0).toArrow()
    w, p, b, total, seen = (got.column(c).to_numpy() for c in ("w", "p1", "b1", "total", "seen"))
    order = np.lexsort((w, -seen))
    table = np.zeros(len(w), _WORD)
    for name, x in (("key", w.view(np.uint64)), ("p", p), ("b", b), ("total", total)):
        table[name] = x[order]
    return words.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, table))


def _rare(m: Model, own: int | None, slices: int, kind: int, shards: int) -> DataFrame:
    """Rows of the words that aren't frequent, of all slices or of one."""
    frequent = m.frequent

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            here = ~_frequent(frequent).find(key)[0]
            if own is not None:
                here &= _slice(key, slices) == own
            out = np.zeros(int(here.sum()), _WORD)
            for name, x in (("key", key), *((c, b.column(i).to_numpy()) for i, c in ((1, "p"), (2, "b"), (3, "total")))):
                out[name] = x[here]
            yield _batch(_rows(kind, out, _shard(out["key"], shards), shards), _BYTES_ROW)

    return m.words.select("w", "p1", "b1", "total").mapInArrow(tidy(run, "perplexity"), _ROW)


def _entries(m: Model, part: int, slices: int, shards: int) -> DataFrame:
    """shard, words, pairs and trigrams: the entries of a slice, in a row for each shard, sorted by key.

    A text's logarithm is a sum of values: base for every word, the value of each word and of each context
    of one and two words, and what a known bigram or trigram is above its back-off."""
    d3, d2, base, frequent = m.d3, m.d2, m.base, m.frequent

    def contexts(table: pa.Table) -> pa.Table:
        """Trigrams with their context's total and weight, to their last two words; contexts to their bigram."""
        t = _once(_records(table, TRIGRAMS, _TOKEN))
        key = _two(t["a"], t["v"])
        order, begin, size = _groups(key)
        t, n = t[order], t["n"][order].astype(np.float64)
        total = np.add.reduceat(n, begin) if len(begin) else np.zeros(0)
        back = np.add.reduceat(n - _less(n, d3), begin) / total if len(begin) else total
        first = t[begin]
        here = _slice(first["a"], slices) == part
        out = np.zeros(int(here.sum()), _CONTEXT)
        out["key"], out["b"] = key[order[begin]][here], np.log(back[here])
        rows = _rows(CONTEXTS, out, _shard(out["key"], shards), shards)
        here = np.flatnonzero(_slice(t["v"], slices) == part)
        here = here[np.argsort(t["v"][here])]
        at, t = np.repeat(np.arange(len(begin)), size)[here], t[here]
        out = np.zeros(len(t), _TRIGRAM)
        out["k3"], out["v"], out["w"] = _three(t["a"], t["v"], t["w"]), t["v"], t["w"]
        out["share"], out["back"] = _less(n[here], d3) / total[at], back[at]
        rows += _rows(TRIGRAMS, out, _shard(_two(t["v"], t["w"]), shards), shards)
        return pa.Table.from_batches([_batch(rows, _BYTES_ROW)])

    def wanted(t: np.ndarray) -> list[tuple]:
        """Words that aren't frequent, and the shards whose bigrams have them."""
        at = [np.flatnonzero(~_frequent(frequent).find(t[c])[0]) for c in "vw"]
        here = np.concatenate(at)
        out = np.zeros(len(here), _WANTED)
        out["key"], out["shard"] = np.concatenate([t[c][i] for c, i in zip("vw", at, strict=True)]), _shard(_two(t["v"][here], t["w"][here]), shards)
        out = _distinct(out)
        return _rows(SENT, out, _shard(out["key"], shards), shards)

    def sent(ask: pa.Table, have: pa.Table) -> pa.Table:
        ask, have = _distinct(_records(ask, SENT, _WANTED)), _records(have, OWN, _WORD)
        have = have[np.argsort(have["key"])]
        out = have[np.searchsorted(have["key"], ask["key"])]
        return pa.Table.from_batches([_batch(_rows(SENT, out, ask["shard"], shards), _BYTES_ROW)])

    def entries(key: tuple, table: pa.Table) -> pa.Table:
        t, c, words, own = (_records(table, k, d) for k, d in ((TRIGRAMS, _TRIGRAM), (CONTEXTS, _CONTEXT), (SENT, _WORD), (OWN, _WORD)))
        words = words[np.argsort(words["key"])]

        def values(key: np.ndarray) -> np.ndarray:
            there, row = _frequent(frequent).find(key)
            out = np.zeros(len(key), _WORD)
            out[there] = _frequent(frequent).words[row[there]]
            out[~there] = words[np.searchsorted(words["key"], key[~there])]
            return out

        k2 = _two(t["v"], t["w"])
        order, begin, n = _groups(k2)
        two = t[order[begin]]
        v, w = values(two["v"]), values(two["w"])
        p2 = np.log(_less(n, d2) / v["total"] + np.exp(v["b"] + w["p"]))
        t, p = t[order], np.repeat(p2, n)
        three = np.zeros(len(t), _GAIN)
        three["key"], three["gain"] = t["k3"], np.log(t["share"] + t["back"] * np.exp(p)) - np.log(t["back"]) - p
        pairs = np.zeros(len(two), _ENTRY)
        pairs["key"], pairs["gain"] = k2[order[begin]], p2 - v["b"] - w["p"]
        lone = np.zeros(len(c), _ENTRY)  # that of two start marks is no bigram
        lone["key"], lone["b"] = c["key"], c["b"]
        at = np.searchsorted(pairs["key"], c["key"])
        there = pairs["key"][np.minimum(at, len(pairs) - 1)] == c["key"] if len(pairs) else np.zeros(len(c), bool)
        pairs["b"][at[there]] = c["b"][there]
        pairs["gain"] += pairs["b"]
        lone["gain"] = lone["b"]
        pairs = np.concatenate([pairs, lone[~there]])
        one = np.zeros(len(own), _ENTRY)
        one["key"], one["gain"], one["b"] = own["key"], own["p"] - base + own["b"], own["b"]
        data = [[_packed(x[np.argsort(x["key"])])] for x in (one, pairs, three)]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {k: pa.array(x, pa.binary()) for k, x in zip(("words", "pairs", "trigrams"), data, strict=True)})

    def first(t: np.ndarray) -> list[tuple]:
        return _rows(TRIGRAMS, t, _shard(_two(t["a"], t["v"]), shards), shards)

    middle = lambda a, v: _slice(v, slices) == part
    three = _tokens(m.texts, first, lambda a, v: middle(a, v) | (_slice(a, slices) == part)).groupBy("shard").applyInArrow(contexts, _ROW)
    rare = _rare(m, None, slices, OWN, shards)
    words = _tokens(m.texts, wanted, middle, once=False).groupBy("shard").cogroup(rare.groupBy("shard")).applyInArrow(sent, _ROW)
    all_ = three.union(words).union(_rare(m, part, slices, OWN, shards))
    return all_.groupBy("shard").applyInArrow(entries, "shard int, words binary, pairs binary, trigrams binary")


def _asked(rows: DataFrame, m: Model, part: int, slices: int, shards: int) -> DataFrame:
    """shard, kind, batch, ids, at, keys and more: what texts (row, text) look up in a slice of the model, the keys of
    a batch of texts in a shard in a row; at is the place of each key's text in ids. more has the trigrams of PAIRS."""
    frequent, base, start_here = m.frequent, m.base, _slice(np.array([_START]), slices)[0] == part
    schema = [("shard", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), *((n, pa.binary()) for n in ("ids", "at", "keys", "more"))]

    def ask(t: Texts):
        """For each kind of key: the text, the key and the trigram; and what the texts have of frequent words."""
        table = _frequent(frequent)
        rare = lambda x: ~table.find(x)[0]
        doc, a, v, w = trigrams(t)
        last = np.flatnonzero(np.diff(doc, append=-1) != 0)
        here = np.flatnonzero(_slice(v, slices) == part)
        end = last[_slice(v[last], slices) == part]
        begin = doc[last] if start_here else doc[:0]
        start, none = np.full(len(begin), _START), np.zeros(len(begin), np.uint64)
        v2, w2 = v[here], w[here]
        own = np.flatnonzero(_slice(w, slices) == part)
        own, own_last = own[rare(w[own])], last[_slice(w[last], slices) == part]
        own_last = own_last[rare(w[own_last])]
        lone = rare(start)
        keys = [
            (np.concatenate([doc[here], begin]), np.concatenate([_two(v2, w2), _two(start, start)]), np.concatenate([_three(a[here], v2, w2), none])),
            (np.concatenate([doc[own], begin[lone]]), np.concatenate([w[own], start[lone]]), None),
            (doc[own_last], w[own_last], None),
            (doc[end], _two(v[end], w[end]), None),
        ]
        return keys, known(table, t.n, doc, w, last) if part == 0 else ()

    def known(table: Frequent, texts: int, doc: np.ndarray, w: np.ndarray, last: np.ndarray):
        """Sum of the values of a text's frequent words, and how many words it has."""
        n = np.bincount(doc, minlength=texts)
        there, at = table.find(w)
        total = np.bincount(doc[there], table.value[at[there]] - base, minlength=texts).astype(np.float64)  # of no words it has integers
        there, at = table.find(w[last])
        total[doc[last[there]]] -= table.words["b"][at[there]]
        there, at = table.find(np.array([_START]))
        return total + np.where(n > 0, table.value[at[0]] - base if there[0] else 0.0, 0.0), n

    def pack(parts, batch):
        begin = np.cumsum([0] + [len(p[0]) for p in parts])
        ids, got = np.concatenate([p[0] for p in parts]), []
        if part == 0:
            got.append((batch % shards, KNOWN, batch, ids.tobytes(), b"", *(np.concatenate([p[2][i] for p in parts]).tobytes() for i in (0, 1))))
        for kind in (PAIRS, WORDS, LAST_WORDS, LAST_PAIRS):
            at = np.concatenate([p[1][kind][0] + i for p, i in zip(parts, begin, strict=False)])
            key = np.concatenate([p[1][kind][1] for p in parts])
            order = np.argsort(key)
            at, key = at[order], key[order]
            more = np.concatenate([p[1][kind][2] for p in parts])[order] if kind == PAIRS else None
            for s, i in _dealt(_shard(key, shards), shards):
                here = np.zeros(len(ids), bool)
                here[at[i]] = True
                place = (np.cumsum(here) - 1)[at[i]].astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
                got.append((s, kind, batch, ids[here].tobytes(), place.tobytes(), _column(key[i], "key"), b"" if more is None else more[i].tobytes()))
        return _batch(got, schema)

    def run(batches):
        from pyspark import TaskContext

        batch, parts, n = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            row = b.column(0).to_numpy()
            for i, j, t in pieces(b, "text", CUT, lower=True):
                keys, own = ask(t)
                parts.append((row[i:j], keys, own))
                n += j - i + sum(len(k[1]) for k in keys)
                if n >= PACK:
                    yield pack(parts, batch)
                    batch, parts, n = batch + 1, [], 0
        if n:
            yield pack(parts, batch)

    return rows.select("row", "text").mapInArrow(tidy(run, "perplexity"), "shard int, kind int, batch long, ids binary, at binary, keys binary, more binary")


def _met(key: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among those held, and where."""
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(held, key), len(held) - 1)
    hit = np.flatnonzero(held[at] == key)
    return hit, at[hit]


def _found(asked: pa.Table, held: pa.Table) -> pa.Table:
    """batch, ids, sums and words: of the values that a shard holds for the keys of each text of a batch, and of
    what it knows itself with the number of its words."""
    out = []
    dtypes = (("words", _ENTRY), ("pairs", _ENTRY), ("trigrams", _GAIN))
    words, pairs, three = tables = [_unpacked(held.column(c)[0], d) if held.num_rows else np.zeros(0, d) for c, d in dtypes]
    word_keys, pair_keys, three_keys = (np.ascontiguousarray(x["key"]) for x in tables)
    for kind, batch, ids, at, keys, more in zip(*(asked.column(c) for c in ("kind", "batch", "ids", "at", "keys", "more")), strict=True):
        kind, batch = kind.as_py(), batch.as_py()
        if kind == KNOWN:
            out.append((batch, ids.as_py(), keys.as_py(), more.as_py()))
            continue
        k, row = _values(np.frombuffer(keys.as_buffer(), np.uint8), np.dtype("u8"), "key"), np.frombuffer(ids.as_buffer(), np.int64)
        p = np.frombuffer(at.as_buffer(), f"u{len(at.as_buffer()) // len(k)}")
        held_keys, entries = (word_keys, words) if kind in (WORDS, LAST_WORDS) else (pair_keys, pairs)
        hit, where = _met(k, held_keys)
        place, value = p[hit], entries["gain"][where] if kind in (PAIRS, WORDS) else -entries["b"][where]
        if kind == PAIRS:  # a trigram is known only if its bigram is
            far = np.frombuffer(more.as_buffer(), np.uint64)[hit]
            order = np.argsort(far)
            hit, where = _met(far[order], three_keys)
            place, value = np.concatenate([place, place[order[hit]]]), np.concatenate([value, three["gain"][where]])
        sums = np.bincount(place, value, minlength=len(row))
        some = np.flatnonzero(np.bincount(place, minlength=len(row)))
        if len(some):
            out.append((batch, row[some].tobytes(), sums[some].tobytes(), b""))
    return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate((("batch", pa.int64()), ("ids", pa.binary()), ("sums", pa.binary()), ("words", pa.binary())))})


def _added(found: pa.Table) -> pa.Table:
    """row, log_p and n_words: the sums of a batch's texts over all shards."""
    ids, sums = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in found.column(c)]) for c, t in (("ids", np.int64), ("sums", np.float64)))
    row, at = np.unique(ids, return_inverse=True)
    n = np.zeros(len(row), np.int64)
    for i, words in zip(found.column("ids"), found.column("words"), strict=True):
        if len(words.as_buffer()):
            where = np.searchsorted(row, np.frombuffer(i.as_buffer(), np.int64))
            np.add.at(n, where, np.frombuffer(words.as_buffer(), np.int64))
    return pa.table({"row": row, "log_p": np.bincount(at, sums, minlength=len(row)), "n_words": n})


def scored(docs: DataFrame, m: Model, slices: int | None = None, rounds: int | None = None) -> DataFrame:
    """doc_id, lang, n_words and log_p (the sum over its words) of each row of docs.

    A row is known by a hash of its id, language and text. Rows that are alike in all three have one sum,
    which is theirs in equal shares. Each slice of the model is built once and then asked in rounds, by
    a part of the rows in each."""
    spark = docs.sparkSession
    bounded(spark)
    row = F.xxhash64("doc_id", "lang", "text", F.isnull("doc_id"), F.isnull("lang"), F.isnull("text"))

    with _brief_shuffles(spark):
        every = durable(docs.select(row.alias("row"), "doc_id", "lang"), "rows")
        slices = slices or _slices(docs)
        rounds = rounds or (ROUNDS if slices == SLICES else 1)
        turn = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(rounds)).alias("turn"), row.alias("row"), "text")
        shards = _shards(docs, slices, m.size)
        sums = []
        for part in range(slices):
            held = durable(_entries(m, part, slices, shards), "model")
            for r in range(rounds):
                asked = _asked(turn.where(F.col("turn") == r), m, part, slices, shards)
                found = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_found, "batch long, ids binary, sums binary, words binary")
                sums.append(durable(found.groupBy("batch").applyInArrow(_added, "row long, log_p double, n_words long"), "sums"))
            forget(held)
        total = reduce(DataFrame.union, sums).groupBy("row").agg(F.sum("log_p").alias("log_p"), F.sum("n_words").alias("n_words"))
        total = total.join(every.groupBy("row").agg(F.count("*").alias("alike")), "row")
        n = (F.col("n_words") / F.col("alike")).cast("long")
        log_p = F.when(F.col("n_words") > 0, n * F.lit(m.base) + F.col("log_p") / F.col("alike")).otherwise(0.0)
        return durable(every.join(total, "row").select("doc_id", "lang", n.alias("n_words"), log_p.alias("log_p")), "sums")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, n_words, perplexity, threshold and kept of each row of docs.

    labels: doc_id, quality (1 is good), toxic (0 is clean); others and nulls aren't trusted. Texts
    without words have a null perplexity and aren't kept; without trusted documents there is no
    threshold and every text with words is kept. A null lang is a language of its own. Repeated rows
    and rows with a null id get a row each; no rows give none. Other columns are not read.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    trains = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)) == 0
    m = model(docs.where(trains).join(good, "doc_id", "left_semi").select("text"))
    s = durable(scored(docs, m).withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_p") / F.col("n_words")))), "scored")
    test = s.where(~trains).join(good, "doc_id", "left_semi").where("perplexity is not null")
    per = test.groupBy(F.coalesce("lang", F.lit("")).alias("l")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"), F.count("*").alias("m")).where(F.col("m") * (1 - quantile) >= INSIDE)
    every = test.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    out = s.join(per, F.coalesce(s["lang"], F.lit("")) == per["l"], "left").withColumn("threshold", F.coalesce("own", F.lit(every).cast("double")))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("n_words") > 0) & (F.col("n_words") > 0)
    return out.select("doc_id", "n_words", "perplexity", "threshold", kept.alias("kept"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
