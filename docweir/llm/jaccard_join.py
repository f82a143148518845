"""Exact n-gram Jaccard self-join of documents, and its components.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. A document's set is
its distinct shingles of n words; with fewer words, all of them as one shingle; without words it is
empty and links with nothing. Two documents link when the Jaccard similarity of their sets is at
least the threshold, a fraction, which is tested in whole numbers.

1. One pass counts every shingle: sorted and packed by slots of the hash range, summed for each
   task before the shuffle. The most frequent shingles of each slot become a dictionary of fixed
   size: shingles outside it come first in the order of a set, by hash, then those in it, by count.
   Any order gives the right links; this one keeps frequent shingles out of the prefixes.
2. A second pass gives for each document the size and a signature of its set, the prefix in that
   order, and how many of its shingles fall into each of SIDES classes. Documents of the same set
   are one class, with the smallest id as representative; only representatives go on.
3. Prefixes meet by shingle. First each document of a shingle's list is paired with one hub of the
   list only, the one with the largest share of frequent shingles (in a group of edited copies that
   is the least edited), so that such a group gives as many pairs as documents; links found so give
   components. A second hub follows if the remaining pairs are far more than the documents. Then
   all pairs across different components are tried: those within one can't change the result.
   Short lists are joined with themselves; long ones are cut into parts of PART documents, and every
   two parts meet in a group of their own.
4. Pairs pass the length filter, the positional filter, and a suffix filter (the sets' counts by
   class bound their difference). Each pair left is verified once, on the whole sets of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded, components, durable, forget, tidy
from .textvec import U, ngrams, pieces

SIDES = 256
#: Lists of up to SHORT documents are joined by Spark, longer ones in parts of PART documents.
SHORT, PART = 32, 1024
#: Entries of the dictionary of frequent shingles, 16 bytes each.
FREQUENT = 1 << 20
#: A shingle in fewer documents than this isn't put in the dictionary.
LEAST = 4


def sets(batch: pa.RecordBatch, name: str, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first, last+1, and rows and hashes of their distinct shingles, by row."""
    for i, j, t in pieces(batch, name, lower=True):
        doc, s, e = t.words()
        d, h = ngrams(doc, t.hashes(s, e), n, j - i)
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        yield i, j, d[first], h[first]


def _pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte, so that the shuffle's compression bites."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def frequent(docs: DataFrame, text: str, n: int, size: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """bits, and in order the leading 32 + bits bits of the hash and the documents of the most frequent
    shingles: the most frequent ones of each of the 2 ** bits slots of the hash range, and of these the
    size most frequent. Exact counts, from all documents. There is a slot for every two million shingles,
    so that a group stays as small however many there are."""
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / 5 / 2e6 + 1)), 6, 31))  # about 2 million shingles a slot
    top, shift = max(16, size >> bits), U(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in batches:
            for _, _, _, h in sets(b, text, n):
                kept.append(h)
                if sum(map(len, kept)) > 2_000_000:
                    yield out(np.concatenate(kept))
                    kept = []
        if kept:
            yield out(np.concatenate(kept))

    def out(h: np.ndarray) -> pa.RecordBatch:
        h, c = np.unique(h >> (shift - U(32)), return_counts=True)  # the slot's bits and 32 more
        slot, low = (h >> U(32)).astype(np.int64), h.astype(np.uint32)
        again = c > 1
        cut = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
        rows = []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            m = again[a:z]
            rows.append((int(slot[a]), _pack(low[a:z][~m]), _pack(low[a:z][m]), c[a:z][m].astype("<u4").tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(("slot", "once", "more", "times"), r, strict=True)) for r in rows], pa.schema([("slot", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("times", pa.binary())]))

    def best(pdf):
        import pandas as pd

        low = np.concatenate([_unpack(x) for c in ("once", "more") for x in pdf[c]])
        c = np.concatenate([np.ones(sum(len(x) // 4 for x in pdf["once"]), np.int64), *[np.frombuffer(x, "<u4") for x in pdf["times"]]])
        order = np.argsort(low, kind="stable")
        low, c = low[order], c[order]
        first = np.flatnonzero(np.diff(low, prepend=low[:1] ^ 1))
        low, c = low[first], np.add.reduceat(c, first)
        low, c = low[c >= LEAST], c[c >= LEAST]
        order = np.sort(np.lexsort((low, -c))[:top])
        key = (np.uint64(pdf["slot"].iloc[0]) << U(32)) + low[order].astype(np.uint64)
        return pd.DataFrame({"keys": [key.tobytes()], "n": [c[order].astype(np.int64).tobytes()]})

    bounded(docs.sparkSession)
    packed = docs.select(text).mapInArrow(tidy(count, "jaccard"), "slot long, once binary, more binary, times binary")
    tops = packed.groupBy("slot").applyInPandas(best, "keys binary, n binary")
    if top << bits <= size:
        rows = tops.collect()  # at most size entries
        key, n_docs = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((0, np.uint64), (1, np.int64)))
    else:  # many slots: the size most frequent entries of all
        spread = lambda b: pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(i).to_pylist()), np.int64)) for i in (0, 1)], ["key", "n"])
        best_of_all = arrow_map(tops, ["keys", "n"], spread, "key long, n long").orderBy(F.desc("n"), "key").limit(size).toArrow()
        key, n_docs = best_of_all["key"].to_numpy().view(np.uint64), best_of_all["n"].to_numpy()
    order = np.argsort(key)
    return bits, key[order], n_docs[order]


def _ranked(bits: int, key: np.ndarray, n: np.ndarray):
    """From the dictionary: leading bits in order, the rank of each (rarest first), bits."""
    rank = np.empty(len(n), np.uint32)
    rank[np.lexsort((key, n))] = np.arange(len(n), dtype=np.uint32)
    return key, rank, bits


def prefix_length(size, num: int, den: int):
    """How many leading shingles two linked sets can't both lack: size - ceil(size * num/den) + 1."""
    return size - -(-size * num // den) + 1


def described(docs: DataFrame, doc_id: str, text: str, n: int, num: int, den: int, table: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, size n, signature s1 and s2, prefix, counts by class (sides) and share of frequent
    shingles of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(_ranked(*table))  # at most FREQUENT entries

    def describe(b: pa.RecordBatch) -> pa.RecordBatch:
        key, rank, bits = shared.value
        sizes, s1, s2 = (np.zeros(b.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
        sides = np.zeros((b.num_rows, SIDES), np.uint8)
        share = np.zeros(b.num_rows)
        parts, lengths = [], np.zeros(b.num_rows, np.int64)
        for i, j, d, h in sets(b, text, n):
            size = np.bincount(d, minlength=j - i)
            sizes[i:j] = size
            full = np.flatnonzero(size) + i
            if len(h):
                start = np.flatnonzero(np.diff(d, prepend=-1))
                s1[full] = np.add.reduceat(h * U(0x9E3779B97F4A7C15) ^ (h >> U(29)), start)
                s2[full] = np.add.reduceat((h ^ (h >> U(31))) * U(0xC2B2AE3D27D4EB4F) ^ (h >> U(17)), start)
                side = np.bincount(d * SIDES + (h & U(SIDES - 1)).astype(np.int64), minlength=(j - i) * SIDES)
                sides[i:j] = np.minimum(side, 255).reshape(-1, SIDES)
            lead = h >> U(32 - bits)
            at = np.searchsorted(key, lead)
            known = at < len(key)
            known[known] = key[at[known]] == lead[known]
            share[i:j] = np.bincount(d[known], minlength=j - i) / np.maximum(size, 1)
            first = np.zeros(len(h), np.uint64)
            first[known] = rank[at[known]].astype(np.uint64) + U(1)
            order = np.lexsort((h, first, d))
            h = h[order]
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            take = np.where(size > 0, prefix_length(size, num, den), 0)
            keep = np.arange(len(h)) - begin[d] < take[d]
            parts.append(h[keep])
            lengths[i:j] = take
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        packed = pa.array([x.tobytes() for x in sides], pa.binary())
        arrays = [b.column(0).cast(pa.int64()), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))), packed, pa.array(share)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "s1", "s2", "prefix", "sides", "share"])

    return arrow_map(docs, [F.col(doc_id).alias("doc_id"), text], describe, "doc_id long, n long, s1 long, s2 long, prefix array<long>, sides binary, share double")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least how many shingles are in just one of two sets, from their counts by class."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(1)


def _sides(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SIDES)


def _near(pairs: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b left by the length and suffix filters: linked sets share num/(num+den) of na + nb."""

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        total = b.column(2).to_numpy() + b.column(3).to_numpy()
        apart = _apart(_sides(b.column(4).to_pylist()), _sides(b.column(5).to_pylist()))
        return b.select(["a", "b"]).filter(pa.array((num + den) * (total - apart) >= 2 * num * total))

    a = meta.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sides").alias("sa"))
    b = meta.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sides").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return arrow_map(both, ["a", "b", "na", "nb", "sa", "sb"], keep, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs a, b whose texts link. pairs: a durable table."""

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.num_rows
        one, size = [], np.zeros((2, rows), np.int64)
        for k, c in enumerate(("ta", "tb")):
            ds, hs = [], []
            for i, j, d, h in sets(b, c, n):
                size[k, i:j] = np.bincount(d, minlength=j - i)
                ds.append(d + i)
                hs.append(h)
            one.append((np.concatenate(ds), np.concatenate(hs)))
        d, h = (np.concatenate([x[k] for x in one]) for k in (0, 1))
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
        inter = np.bincount(d[1:][same], minlength=rows)
        ok = den * inter >= num * (size.sum(0) - inter)
        return b.select(["a", "b"]).filter(pa.array(ok))

    ids = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    # 8 bytes an id: small enough a set goes to the texts, else the texts go to the ids
    ids = F.broadcast(ids) if ids.count() <= 500_000 else ids
    texts = durable(docs.join(ids, "doc_id", "left_semi"), "texts")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return durable(arrow_map(pairs.join(a, "a").join(b, "b"), ["a", "b", "ta", "tb"], check, "a long, b long"), "links")


def _short(post: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs a < b of different components in a short list, left by the length and positional
    filters. post: token, doc, n, pos, comp."""
    a = post.select("token", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("comp").alias("ca"))
    b = post.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j"), F.col("comp").alias("cb"))
    reach = F.least("i", "j") + 1 + F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1)
    ok = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (reach * (num + den) >= (F.col("na") + F.col("nb")) * num)
    return a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ok).select("a", "b").distinct()


def _long(post: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs a < b of different components in a long list, left by the length, positional and
    suffix filters. post: token, doc, n, pos, sides, comp, parts (of the list).

    Lists come here after the hub rounds, with what still holds different components. Each document of a
    list of m is copied m / PART times, and a group holds two parts: the pairs to try grow with m * m, as
    they must, the memory of a group doesn't."""

    def meet(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("doc")
        doc, n, pos, comp, part = (pdf[c].to_numpy() for c in ("doc", "n", "pos", "comp", "part"))
        sides, x, y = _sides(pdf["sides"]), int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        out = []
        for i in np.flatnonzero(part == x):
            j = np.flatnonzero((part == y) & (comp != comp[i]) & ((doc > doc[i]) | (x != y)))
            total = n[i] + n[j]
            reach = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
            j = j[(np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & (reach * (num + den) >= total * num)]
            apart = _apart(sides[i : i + 1], sides[j])
            j = j[(num + den) * (n[i] + n[j] - apart) >= 2 * num * (n[i] + n[j])]
            out.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], 1))
        out = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    part = post.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    other = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = other.select("token", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "doc", "n", "pos", "sides", "comp")
    return met.groupBy("token", "x", "y").applyInPandas(meet, "a long, b long").distinct()


def _lists(p: DataFrame, k: int) -> DataFrame:
    """The lists that hold different components: token, hub, m (documents), w (sum of squares of the
    components' documents)."""
    hub = F.max_by("doc", F.struct("share", -F.col("doc"))) if k == 0 else F.max_by("doc", F.xxhash64("doc", F.lit(k)))
    by = p.groupBy("token", "comp").agg(F.count("*").alias("c"), hub.alias("hub"), F.max(F.struct("share", -F.col("doc")) if k == 0 else F.xxhash64("doc", F.lit(k))).alias("key"))
    lists = by.groupBy("token").agg(F.count("*").alias("comps"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("w"), F.max_by(F.struct("hub", "comp"), "key").alias("h"))
    return durable(lists.where("comps > 1").select("token", "m", "w", F.col("h.hub").alias("hub"), F.col("h.comp").alias("hub_comp")), "lists")


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    component_id is the smallest id reachable by links, itself included. Null texts count as empty.
    A row with a null id gets a null component_id and links with nothing. Rows that repeat an id and
    a text are one node; an id stands for one text. No rows give none. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = frequent(docs, "text", n)
    t = durable(described(docs, "doc_id", "text", n, num, den, table), "sets")
    some = t.where("n > 0 and doc_id is not null")
    classes = durable(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    meta = some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    whole = durable(meta.select(F.col("doc_id").alias("doc"), F.posexplode("prefix").alias("pos", "token")), "prefixes")
    met = durable(whole.groupBy("token").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("token"), "met")
    few = whole.join(met, "token")
    of = meta.select(F.col("doc_id").alias("doc"), "n", "share", "sides").distinct()
    post = durable(few.join(of.drop("sides"), "doc"), "postings")
    forget(whole)
    meta = durable(of.join(post.select("doc").distinct(), "doc", "left_semi").withColumnRenamed("doc", "doc_id"), "meta")

    p = post.withColumn("comp", F.col("doc"))
    links = tried = None
    for k in range(rounds):
        lists = _lists(p, k)
        if k:
            left, nodes = lists.agg(F.sum((F.col("m") * F.col("m") - F.col("w")) / 2)).first()[0] or 0, meta.count()
            if left <= 20 * nodes:
                break
        pairs = p.join(lists.select("token", "hub", "hub_comp"), "token").where("comp <> hub_comp")
        pairs = pairs.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = durable(_near(pairs, meta, num, den), "pairs")
        new = _verified(pairs, docs, n, num, den)
        links, tried = (new, pairs) if k == 0 else (links.union(new), tried.union(pairs))
        comp = durable(components(links), "component")
        p = post.join(comp.withColumnRenamed("id", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    else:
        lists = _lists(p, rounds)
    across = durable(p.join(lists.select("token", "m", F.ceil(F.col("m") / PART).cast("int").alias("parts")), "token"), "across")
    long = across.where(F.col("m") > SHORT).join(meta.select(F.col("doc_id").alias("doc"), "sides"), "doc")
    pairs = _near(_short(across.where(F.col("m") <= SHORT), num, den), meta, num, den).union(_long(long, num, den)).distinct()
    pairs = durable(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    comp = durable(components(links.union(_verified(pairs, docs, n, num, den))), "component")
    out = t.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without those whose component has a smaller id: one document of each group.

    Rows with a null id are kept; of rows that repeat an id and are kept, all stay.
    """
    gone = join(docs, **how).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
