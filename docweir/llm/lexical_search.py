"""Ranked lexical search over posting lists in geometric blocks.

Documents and items are sets of terms with counts; a document's score for an item sums over the item's terms
the term's weight times its impact there, in whole numbers (see `impact`). The best documents of every item
are found exactly, without scoring most of the others:

1. One pass over the texts keeps of each document its length and its counts of the items' terms, sharded as
   the texts are. Numbers of documents, lengths and document frequencies are sums of counts by task.
2. Documents that hold an item's rarest terms give a first threshold, the k-th best of their scores. The
   rarest terms without which no document can reach it are the item's leading terms: their posting lists
   have to be read, the others' not.
3. The documents' vectors are sorted by their strongest terms and cut into shards of neighbours. In a shard
   each leading term has its posting list, which is clustered: ordered by the strongest of the other terms
   that items ask together with this one, so that alike documents meet, and cut into blocks. A block's
   summary is the coordinatewise maximum of its documents' impacts over those terms. Shards are a table.
4. An item's blocks in a shard are met from the highest bound down. The bound is the summary's score without
   the item's terms that are rarer than the list's: documents that have one are in that one's list. A block
   is left out only where its exact bound is below the k-th best score so far (the first threshold or the
   task's own). Documents left are scored once each, and each task emits k of them for an item at most.

A term in all documents is a long list only in the shards, each of which has a fixed number of documents;
copies of one text share a sort key and are spread over partitions by their hash. Items are broadcast in
groups of at most ENTRIES terms; more items are searched group by group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import bounded, durable, enter, forget
from .textvec import Texts, pieces

#: Terms of the items that are searched at once; documents of a shard and of a block.
ENTRIES, SHARD, BLOCK = 1 << 19, 2048, 16
#: Documents that the first threshold of an item is taken from, by its rarest terms: so many or more.
FIRST = 500

TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each term: a run of letters, digits and characters beyond ASCII."""
    edge = np.flatnonzero(np.diff(~TERM[t.buf], prepend=True))
    s, e = edge[::2], edge[1::2]
    return np.searchsorted(t.start, s, "right") - 1, t.hashes(s, e)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Of a term that occurs tf times among the n terms of a document, with n_docs documents of total terms."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // max(total, 1)))


@dataclass
class Items:
    """A group of items. number: of each; ptr, term: its terms as places in voc; voc: hashes in order."""

    number: np.ndarray
    ptr: np.ndarray
    term: np.ndarray
    voc: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.term[self.ptr[i] : self.ptr[i + 1]]


@dataclass
class Corpus:
    """What scoring needs of all documents; lead: each item's leading terms; first: its first threshold."""

    n_docs: int
    total: int
    weight: np.ndarray
    lead: list[np.ndarray]
    first: np.ndarray


def itemised(items: DataFrame) -> DataFrame:
    """item (a number of its own for each row), item_id and terms (distinct hashes) of each row of items."""
    kind = items.schema["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enter("search")
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, j, t in pieces(b, "text", lower=True):
                doc, h = terms(t)
                lists = [np.unique(h[x:y]).view(np.int64) for x, y in _spans(doc, j - i)]
                rows = pa.array(np.arange(at + i, at + j))
                yield pa.RecordBatch.from_arrays([rows, b.column(0).slice(i, j - i), pa.array(lists, pa.list_(pa.int64()))], ["item", "item_id", "terms"])
            at += b.num_rows

    bounded(items.sparkSession)
    return items.select("item_id", "text").mapInArrow(run, StructType([StructField("item", LongType()), kind, StructField("terms", ArrayType(LongType()))]))


def _spans(doc: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    at = np.searchsorted(doc, np.arange(n + 1))
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _group(rows: list) -> Items:
    lists = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
    flat = np.concatenate([np.zeros(0, np.uint64), *lists])
    voc, term = np.unique(flat, return_inverse=True)
    return Items(np.array([r["item"] for r in rows], np.int64), np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64), term, voc)


def _lists(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values).cast(kind))


def vectors(docs: DataFrame, voc: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), and of voc's terms that a document has their places and counts (term,
    tf), of each row of docs with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)  # at most ENTRIES terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        voc = shared.value
        for b in batches:
            for i, j, t in pieces(b, "text", lower=True):
                doc, h = terms(t)
                n = np.bincount(doc, minlength=j - i)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                doc = np.cumsum(n > 0)[doc] - 1
                if len(voc):
                    at = np.minimum(np.searchsorted(voc, h), len(voc) - 1)
                    known = voc[at] == h
                    key, tf = np.unique(doc[known] * len(voc) + at[known], return_counts=True)
                    doc, term = np.divmod(key, len(voc))
                else:
                    doc, term, tf = (np.zeros(0, np.int64),) * 3
                ptr = np.searchsorted(doc, np.arange(len(some) + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + some)), pa.array(n[some]), _lists(term, ptr), _lists(tf, ptr)], ["doc_id", "n", "term", "tf"])

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class _Batch:
    """Vectors of some documents: entries by document, with impacts."""

    def __init__(self, ids: pa.Array, n: np.ndarray, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray, corpus: Corpus | None):
        self.ids, self.n, self.ptr, self.term, self.tf = ids, n, ptr, term, tf
        self.doc = np.repeat(np.arange(len(n)), np.diff(ptr))
        if corpus:
            self.x = impact(tf, n[self.doc], corpus.n_docs, corpus.total)

    @staticmethod
    def read(batches: list[pa.RecordBatch], corpus: Corpus | None) -> _Batch:
        t = pa.Table.from_batches(batches).combine_chunks()
        ids, n = (t.column(c).combine_chunks() for c in ("doc_id", "n"))
        lists, tf = (t.column(c).combine_chunks() for c in ("term", "tf"))
        ptr = lists.offsets.to_numpy().astype(np.int64)
        return _Batch(ids, n.to_numpy(), ptr - ptr[0], lists.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), corpus)

    def score(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the docs (each once), with the terms' weights for an item, 0 for others."""
        at, size = _ranges(self.ptr, docs)
        gain = np.append(0, np.cumsum(weight[self.term[at]] * self.x[at]))
        end = np.cumsum(size)
        return gain[end] - gain[end - size]


def _ranges(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ptr[r] .. ptr[r + 1] of all rows, one after the other, and how many each has."""
    size = ptr[rows + 1] - ptr[rows]
    end = np.cumsum(size)
    return np.repeat(ptr[rows] - end + size, size) + np.arange(end[-1] if len(end) else 0), size


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    return np.lexsort((ids, -scores))[:k]


def _ids(a: pa.Array) -> np.ndarray:
    """Ids to compare: a null comes last."""
    return a.fill_null((1 << 63) - 1).to_numpy()


def _per_task(table: DataFrame, shape: int, add, schema: str, emit) -> DataFrame:
    """emit() of what add() has summed up over a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        state = np.zeros(shape, np.int64)
        for b in batches:
            if b.num_rows:
                add(state, b)
        yield emit(state)

    return table.mapInArrow(run, schema)


def frequencies(table: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of size terms. Summed for each task before the shuffle."""

    def add(df: np.ndarray, b: pa.RecordBatch) -> None:
        df += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)

    def emit(df: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(df)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    rows = _per_task(table.select("term"), size, add, "term long, n long", emit).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def _thresholds(table: DataFrame, items: Items, corpus: Corpus, df: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's k-th best score among the documents with its rarest terms (0 if there are fewer), and
    each term's greatest impact."""
    rare = []
    for i in range(len(items.number)):
        own = items.of(i)
        own = own[df[own] > 0]
        own = own[np.argsort(df[own], kind="stable")]
        rare.append(own[: int(np.searchsorted(np.cumsum(df[own]), FIRST)) + 1])
    shared = table.sparkSession.sparkContext.broadcast((items, corpus, rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        items, corpus, rare = shared.value
        size = len(corpus.weight)
        most, best = np.zeros(size, np.int64), [np.zeros(0, np.int64) for _ in rare]
        weight = np.zeros(size, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v = _Batch.read([b], corpus)
            np.maximum.at(most, v.term, v.x)
            order = np.argsort(v.term, kind="stable")
            at = np.searchsorted(v.term[order], np.arange(size + 1))
            for i, own in enumerate(rare):
                where, _ = _ranges(at, own)
                if len(where):
                    mine = items.of(i)
                    weight[mine] = corpus.weight[mine]
                    new = v.score(np.unique(v.doc[order[where]]), weight)
                    best[i] = -np.sort(-np.concatenate([best[i], new]))[:k]
                    weight[mine] = 0
        at = np.flatnonzero(most)
        flat = np.concatenate([most[at], *best])
        item = np.repeat(np.arange(len(rare)), [len(x) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.ones(len(at), bool), np.zeros(len(item), bool))), pa.array(np.append(at, item)), pa.array(flat)], ["of_term", "key", "value"])

    rows = durable(table.mapInArrow(run, "of_term boolean, key long, value long"), "thresholds")
    most = np.zeros(len(items.voc), np.int64)
    got = rows.where("of_term").groupBy("key").agg(F.max("value").alias("value")).toArrow()
    most[got["key"].to_numpy()] = got["value"].to_numpy()
    first = np.zeros(len(items.number), np.int64)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("value")))
    got = rows.where("not of_term").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).toArrow()
    first[got["key"].to_numpy()] = got["value"].to_numpy()
    forget(rows)
    return first, most


def described(table: DataFrame, items: Items, k: int) -> Corpus:
    """Statistics of all documents of table (vectors), and each item's threshold and leading terms."""
    n_docs, total = (int(x or 0) for x in table.agg(F.count("*"), F.sum("n")).first())
    df = frequencies(table, len(items.voc))
    corpus = Corpus(n_docs, total, np.array([weight(n_docs, int(x)) for x in df], np.int64), [], np.zeros(len(items.number), np.int64))
    corpus.first, most = _thresholds(table, items, corpus, df, k)
    for i in range(len(items.number)):
        own = items.of(i)
        own = own[df[own] > 0]
        own = own[np.argsort(df[own], kind="stable")]  # rarest first
        rest = np.cumsum((corpus.weight[own] * most[own])[::-1])[::-1]  # what this and all commoner terms can give
        corpus.lead.append(own[rest >= corpus.first[i]])
    return corpus


_SHARD = "ids array<long>, n array<long>, ptr array<int>, term array<int>, tf array<int>, lists array<int>, blocks array<int>, docs array<int>, sums array<int>, dims array<int>, most array<int>"


def shards(table: DataFrame, items: Items, corpus: Corpus, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The index, a row for each shard: the documents' vectors (ids, n; ptr, term, tf), and the blocks by
    term (lists), with their documents (blocks, docs) and their summaries (sums, dims, most)."""
    together: dict[int, list[np.ndarray]] = {}
    for i, lead in enumerate(corpus.lead):
        for t in lead.tolist():
            together.setdefault(t, []).append(items.of(i))
    shared = table.sparkSession.sparkContext.broadcast((corpus, {t: np.unique(np.concatenate(x)) for t, x in together.items()}))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        corpus = shared.value[0]
        size = len(corpus.weight)
        for b in batches:
            v = _Batch.read([b], corpus) if b.num_rows else None
            if v is None or not len(v.term):
                continue
            order = np.lexsort((v.term, -(corpus.weight[v.term] * v.x), v.doc))
            key = np.zeros(len(v.n), np.int64)
            for j in range(3):  # the three strongest terms
                at = v.ptr[:-1] + j
                has = at < v.ptr[1:]
                key = key * (size + 1) + np.where(has, v.term[order[np.minimum(at, len(order) - 1)]] + 1, 0)
            some = pa.array(np.flatnonzero(np.diff(v.ptr)))
            yield pa.RecordBatch.from_arrays([*[c.take(some) for c in b.columns], pa.array(key).take(some)], [*b.schema.names, "near"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                room = shard - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) == shard:
                    yield _shard(_Batch.read(held, shared.value[0]), *shared.value, block)
                    held = []
        if held:
            yield _shard(_Batch.read(held, shared.value[0]), *shared.value, block)

    near = table.mapInArrow(keyed, "doc_id long, n long, term array<int>, tf array<int>, near long")
    dealt = near.withColumn("at", F.xxhash64("doc_id", "n")).repartitionByRange("near", "at").sortWithinPartitions("near", "at")
    return dealt.select("doc_id", "n", "term", "tf").mapInArrow(build, _SHARD)


def _shard(v: _Batch, corpus: Corpus, together: dict[int, np.ndarray], width: int) -> pa.RecordBatch:
    order = np.argsort(v.term, kind="stable")
    at = np.searchsorted(v.term[order], np.arange(len(corpus.weight) + 1))
    asked = np.zeros(len(corpus.weight), bool)
    gain = corpus.weight[v.term] * v.x
    lists, docs, sizes, dims, most, counts = [], [], [], [], [], []
    for t in np.unique(v.term).tolist():
        if t not in together:
            continue
        mine = v.doc[order[at[t] : at[t + 1]]]
        asked[together[t]] = True
        where, size = _ranges(v.ptr, mine)
        keep = asked[v.term[where]]
        asked[together[t]] = False
        row, where = np.repeat(np.arange(len(mine)), size)[keep], where[keep]
        term, x = v.term[where], v.x[where]
        if len(mine) > width:
            # the strongest other term of each posting; alike postings come together
            other = np.where(term == t, -1, gain[where])
            by = np.lexsort((-other, row))
            first = by[np.searchsorted(row, np.arange(len(mine)))]
            place = np.empty(len(mine), np.int64)
            turn = np.lexsort((mine, -other[first], np.where(other[first] < 0, -1, term[first])))
            place[turn] = np.arange(len(mine))
            mine, row = mine[turn], place[row]
        block = row // width
        key, inverse = np.unique(block * len(corpus.weight) + term, return_inverse=True)
        top = np.zeros(len(key), np.int64)
        np.maximum.at(top, inverse, x)
        n = -(-len(mine) // width)
        lists.append(np.full(n, t))
        docs.append(mine)
        sizes.append(np.diff(np.append(np.arange(n) * width, len(mine))))
        dims.append(key % len(corpus.weight))
        most.append(top)
        counts.append(np.bincount(key // len(corpus.weight), minlength=n))
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    ints = [v.ptr, v.term, v.tf, flat(lists), np.append(0, np.cumsum(flat(sizes))), flat(docs), np.append(0, np.cumsum(flat(counts))), flat(dims), flat(most)]
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    names = ["ids", "n", "ptr", "term", "tf", "lists", "blocks", "docs", "sums", "dims", "most"]
    return pa.RecordBatch.from_arrays([one(v.ids.cast(pa.int64())), one(pa.array(v.n)), *[one(pa.array(x.astype(np.int32))) for x in ints]], names)


def visited(index: DataFrame, items: Items, corpus: Corpus, k: int) -> DataFrame:
    """item, doc_id and score of the documents that may be among an item's k best, k for each task and item
    at most; and a row for each task (item is null) of how many blocks it met and how many it scored."""
    shared = index.sparkSession.sparkContext.broadcast((items, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        items, corpus = shared.value
        best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in corpus.lead]
        weight, turn = np.zeros(len(corpus.weight), np.int64), np.full(len(corpus.weight), 1 << 30)
        met = scored = 0
        for b in batches:
            for r in range(b.num_rows):
                ids, n, ptr, term, tf, lists, blocks, docs, sums, dims, most = (b.column(c).slice(r, 1).flatten() for c in range(11))
                n, ptr, term, tf, lists, blocks, docs, sums, dims, most = (x.to_numpy().astype(np.int64) for x in (n, ptr, term, tf, lists, blocks, docs, sums, dims, most))
                v, keys = _Batch(ids, n, ptr, term, tf, corpus), _ids(ids)
                at = np.searchsorted(lists, np.arange(len(corpus.weight) + 1))
                for i, lead in enumerate(corpus.lead):
                    own, per_term = _ranges(at, lead)
                    if not len(own):
                        continue
                    met += len(own)
                    mine = items.of(i)
                    weight[mine] = corpus.weight[mine]
                    turn[lead] = np.arange(len(lead))
                    where, size = _ranges(sums, own)
                    # in a term's list only documents without the item's rarer terms matter: those are in rarer lists
                    rarer = turn[dims[where]] < np.repeat(np.repeat(np.arange(len(lead)), per_term), size)
                    turn[lead] = 1 << 30
                    bound = np.add.reduceat(np.where(rarer, 0, weight[dims[where]] * most[where]), np.cumsum(size) - size)
                    floor = max(1, int(corpus.first[i]), int(best[i][1][k - 1]) if len(best[i][1]) == k else 0)
                    hopeful = np.flatnonzero(bound >= floor)
                    hopeful = hopeful[np.argsort(-bound[hopeful], kind="stable")]
                    seen = np.zeros(0, np.int64)
                    step = 4
                    while len(hopeful):
                        now, hopeful = hopeful[:step], hopeful[step:]
                        step *= 2
                        scored += len(now)
                        new = np.setdiff1d(docs[_ranges(blocks, own[now])[0]], seen)
                        seen = np.concatenate([seen, new])
                        s = v.score(new, weight)
                        good = s >= floor
                        key, s = np.append(best[i][0], keys[new[good]]), np.append(best[i][1], s[good])
                        top = _best(key, s, k)
                        best[i] = key[top], s[top]
                        if len(top) == k:
                            floor = max(floor, int(s[top[-1]]))
                        hopeful = hopeful[bound[hopeful] >= floor]
                    weight[mine] = 0
        item = np.repeat(items.number, [len(x) for x, _ in best])
        key, s = (np.concatenate([np.zeros(0, np.int64), *[x[c] for x in best]]) for c in (0, 1))
        none = pa.nulls(len(item), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(key, mask=key == (1 << 63) - 1), pa.array(s), none, none], ["item", "doc_id", "score", "met", "scored"])
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([met]), pa.array([scored])], ["item", "doc_id", "score", "met", "scored"])

    return index.mapInArrow(run, "item long, doc_id long, score long, met long, scored long")


def searched(docs: DataFrame, items: DataFrame, k: int = 50, entries: int = ENTRIES, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(ranks, blocks). ranks: item_id, rank, doc_id and score of the k best documents of each row of items,
    those with a score above 0. blocks: met and scored, how many blocks the tasks met and did not leave out.

    A null or empty text has no terms: such a document isn't counted or found, such an item finds none. Rows
    that repeat an id are documents, or items, of their own; a null doc_id comes after all others of its
    score; no documents or no items give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    known = durable(itemised(items), "items")
    groups = -(-(known.agg(F.sum(F.size("terms"))).first()[0] or 0) // entries)
    found = []
    for g in range(groups):
        own = _group(known.where((F.pmod(F.xxhash64("item"), F.lit(groups)) == g) & (F.size("terms") > 0)).select("item", "terms").collect())
        table = durable(vectors(docs, own.voc), "vectors")
        corpus = described(table, own, k)
        index = durable(shards(table, own, corpus, shard, block), "shards")
        found.append(durable(visited(index, own, corpus, k), "visited"))
        forget(table)
        forget(index)
    schema = "item long, doc_id long, score long, met long, scored long"
    all_found = spark.createDataFrame([], schema)
    for x in found:
        all_found = all_found.union(x)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranks = all_found.where("item is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranks = ranks.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
    return ranks, all_found.where("item is null").select("met", "scored")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))[0]
