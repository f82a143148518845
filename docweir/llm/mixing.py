"""Mixing sources to target weights.

Sizes are in words. Each source's words, document after document, are packed into blocks of BLOCK
words (the last may be shorter). Every output shard draws how many of its slots each source fills
from a multinomial distribution; a source's k-th slot over all shards takes the block that a
pseudorandom permutation of the source's block numbers gives k modulo their count, so that a source
is used up before any block of it comes again. Blocks and slots are joined by source and number.

The draws are held to the targets: a source's slots beyond its quota fall away and those that it
lacks are filled in a last shard, so that what it gives differs from its target by about a block.

On the driver are a row for each source and a count for each source and output shard of SHARD_SLOTS slots,
one number for some 64 million words; slots come from a range, whose numbers tell source and slot.
A row is known by a digest of its id, source and text. The order of a source's documents is that of the
digest, so that a source of any size is laid out by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_map, durable, tidy
from .textvec import pieces

BLOCK, SEED = 64, 20240607
#: Slots of an output shard (64 million words) and of a task.
SHARD_SLOTS, TASK_SLOTS = 1 << 20, 1 << 20
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: list[float], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """total shared by weight, no source above most times its size, the excess reshared by weight
    until none is above. If all are full, the rest is not given."""
    out, full = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        w = sum(w for w, f in zip(weights, full, strict=True) if not f)
        if w == 0:
            return [most * s for s in sizes]
        over = False
        for i, s in enumerate(sizes):
            if not full[i]:
                out[i] = rest * weights[i] / w
        for i, s in enumerate(sizes):
            if not full[i] and out[i] > most * s:
                full[i], out[i], over = True, most * s, True
        if not over:
            return out


def _digest(doc_id: str, text: str, source: str) -> Column:
    """128 bits of id, source and text: equal only for rows that are alike in all three."""
    said = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    size = F.coalesce(F.length(F.col(source)), F.lit(-1)).cast("string")
    return F.unhex(F.md5(F.concat_ws("|", said(doc_id), size, said(source), said(text)).cast("binary")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, digest and size of each row."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(b.num_rows, np.int64)
        for i, j, t in pieces(b, "text"):
            n[i:j] = np.bincount(t.words()[0], minlength=j - i)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n)], ["doc_id", "source", "digest", "size"])

    columns = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _digest(doc_id, text, source).alias("digest"), F.col(text).alias("text")]
    return arrow_map(docs, columns, count, "doc_id long, source string, digest binary, size long")


def _permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: four Feistel rounds on as few bits as hold
    n - 1, repeated while the result is outside (at most a quarter of the values are inside)."""
    half = (np.maximum(np.ceil(np.log2(np.maximum(n, 2))), 2).astype(np.uint64) + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = k.astype(np.uint64), np.ones(len(k), bool)
    while todo.any():
        a, b, h, m, s = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for r in range(4):
            f = b * np.uint64(0x9E3779B97F4A7C15) ^ s * np.uint64(2 * r + 3)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (f >> np.uint64(32))) & m
        x[todo] = (a << h) | b
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def draws(quota: np.ndarray, per_shard: int = SHARD_SLOTS, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot of the source, slots) for each shard, in all quota slots of each
    source: multinomial counts, held to the quotas, and a last shard for what they left."""
    total = int(quota.sum())
    if not total:
        return []
    shards = max(1, total // per_shard)
    size = np.diff(np.linspace(0, total, shards + 1).astype(np.int64))
    rng = np.random.default_rng(seed)
    have, rows = np.zeros(len(quota), np.int64), []
    for shard, n in enumerate(size):
        c = np.minimum(rng.multinomial(n, quota / total), quota - have)
        rows += [(int(shard), s, int(have[s]), int(c[s])) for s in np.flatnonzero(c).tolist()]
        have += c
    return rows + [(shards, s, int(have[s]), int(quota[s] - have[s])) for s in np.flatnonzero(quota - have).tolist()]


def slots(spark: SparkSession, drawn: list[tuple[int, int, int, int]], blocks: np.ndarray) -> DataFrame:
    """shard, s, slot (of the source) and block of every slot: a range of all slots, cut by shard and
    source, and the permuted number of a block of the source."""
    shard, source, first, n = (np.array([r[i] for r in drawn], np.int64) for i in range(4))
    ends = np.cumsum(n)
    table = spark.sparkContext.broadcast((shard, source, first, ends, ends - n, blocks))  # a row for each shard and source
    total = int(ends[-1]) if len(ends) else 0

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        shard, source, first, ends, begins, blocks = table.value
        k = b.column(0).to_numpy()
        at = np.searchsorted(ends, k, "right")
        s, slot = source[at], first[at] + k - begins[at]
        many = blocks[s]
        lap = slot // many  # a lap through a source has an order of its own
        key = s.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(SEED)
        block = _permuted(slot % many, many, key ^ lap.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        return pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(s.astype(np.int32)), pa.array(slot), pa.array(block)], ["shard", "s", "slot", "block"])

    return arrow_map(spark.range(0, total, 1, max(8, -(-total // TASK_SLOTS))), ["id"], place, "shard long, s int, slot long, block long")


def _laid_out(rows: DataFrame, largest: int) -> DataFrame:
    """rows (digest, s, size) with at, the number of words of its source before each, and k, its number
    among the rows of its digest. Sums of the buckets of a source first, then sums within a bucket, each
    of about 20 000 rows at most, but for the rows of one digest."""
    n = max(64, -(-largest // 20_000))
    b = rows.withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(SEED)), F.lit(n)).cast("int"))
    sums = b.groupBy("s", "bucket").agg(F.sum("size").alias("z"))
    base = sums.withColumn("base", F.sum("z").over(Window.partitionBy("s").orderBy("bucket")) - F.col("z"))
    order = Window.partitionBy("s", "bucket").orderBy("digest")
    inner = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    k = F.row_number().over(order) - F.rank().over(order) + 1
    laid = b.withColumn("inner", inner - F.col("size")).withColumn("k", k).join(base.select("s", "bucket", "base"), ["s", "bucket"])
    return laid.select("digest", "k", "s", "size", (F.col("base") + F.col("inner")).alias("at"))


def plan(docs: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, most: float = 2.0, per_shard: int = SHARD_SLOTS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, parts, slots). rows: doc_id, source, digest, size, s, source_size, target of each row.
    parts: digest, k (number among the rows of the digest), s, size, block, first and stop, for each part of
    a row in a block: words first..stop-1 of the text. slots: shard, s, slot, block of each slot of the mix.

    A null text has size 0 and no parts; a null source is a source of its own, the last; a null id is an id
    like others. Rows alike in id, source and text are laid out one after the other. No rows give none.
    """
    spark = docs.sparkSession
    rows = durable(sized(docs, doc_id, text, source), "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    per = sorted(per, key=lambda r: (r.source is None, r.source or ""))
    sizes = [float(r["size"]) for r in per]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], share * sum(sizes), most)
    blocks = np.array([-(-int(z) // BLOCK) for z in sizes], np.int64)
    quota = np.array([round(b * g / z) if z else 0 for b, g, z in zip(blocks, goal, sizes, strict=True)], np.int64)
    quota = np.minimum(quota, (blocks * most).astype(np.int64))
    src = spark.createDataFrame([(r.source, i, int(r["size"]), g) for i, (r, g) in enumerate(zip(per, goal, strict=True))], "_source string, s int, source_size long, target double")
    rows = rows.join(src, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = _laid_out(rows.where("size > 0").select("digest", "s", "size"), max((r.n for r in per), default=0))
    parts = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK))))
    first = F.greatest(F.col("block") * BLOCK - F.col("at"), F.lit(0))
    stop = F.least((F.col("block") + 1) * BLOCK - F.col("at"), F.col("size"))
    parts = parts.select("digest", "k", "s", "size", "block", first.alias("first"), stop.alias("stop"))
    return rows, parts, slots(spark, draws(quota, per_shard), blocks)


def _taken(parts: DataFrame, drawn: DataFrame) -> DataFrame:
    """parts with times, how many slots take their block. Merge: Spark can't know the size of the slots."""
    times = drawn.groupBy("s", "block").agg(F.count("*").alias("times"))
    return parts.join(times.hint("merge"), ["s", "block"])


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs.

    A null text has size 0 and is never taken, a null source is a source of its own, the last; a null id
    is an id like others. Rows that repeat an id are taken each for itself, never more than twice their
    size; which of the rows that are alike in id, source and text gets which count is left open. Sources
    without words have target 0. No rows give none. Other columns are not read.
    """
    rows, parts, drawn = plan(docs, **how)
    per = _taken(parts, drawn).groupBy("digest", "k").agg(F.sum((F.col("stop") - F.col("first")) * F.col("times")).alias("taken"))
    alike = Window.partitionBy("digest").orderBy("s")
    out = rows.withColumn("k", F.row_number().over(alike)).join(per, ["digest", "k"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shard_blocks(docs: DataFrame, **how) -> DataFrame:
    """shard, slot, source, block and words of every slot of the mix, the words of its block's parts in
    the order in which their documents are laid out: what training reads, shard by shard."""
    rows, parts, drawn = plan(docs, **how)
    texts = docs.select(_digest("doc_id", "text", "source").alias("digest"), "text").dropDuplicates(["digest"])
    w = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    said = parts.join(texts, "digest").select("s", "block", "digest", "k", "first", F.slice(w, (F.col("first") + 1).cast("int"), (F.col("stop") - F.col("first")).cast("int")).alias("w"))
    body = said.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("digest", "k", "first", "w"))).alias("p"))
    names = rows.select("s", "source").distinct()
    out = drawn.join(body.hint("merge"), ["s", "block"]).join(names, "s")
    return out.select("shard", "slot", "source", "block", F.array_join(F.flatten(F.transform("p", lambda p: p["w"])), " ").alias("words"))


def _cut(batches):
    """The words first..stop-1 of each text for each of its parts, joined by line feeds between
    parts that don't touch."""
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index("text")
        parts = b.column(b.schema.get_field_index("_docweir_parts")).to_pylist()
        out: list[str] = []
        for i, j, t in pieces(b, "text"):
            doc, s, e = t.words()
            begin = np.searchsorted(doc, np.arange(j - i))
            for k in range(i, j):
                w, said = begin[k - i], []
                for p in parts[k]:
                    if said and said[-1][1] == p["first"]:
                        said[-1] = (said[-1][0], p["stop"])
                    else:
                        said.append((p["first"], p["stop"]))
                out.append("\n".join(bytes(t.buf[s[w + x] : e[w + y - 1]]).decode() for x, y in said))
        names = [n for n in b.schema.names if n != "_docweir_parts"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(b.schema.get_field_index(n)) for n in names], names)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix: for each row of docs and each time that parts of it are taken (first, second), a row
    with its columns, text being the words of these parts (and n_chars, if there, counted anew).

    Each row of docs gives its own words, also where ids repeat or are null; their sum is what mix_report
    says. Null and empty texts are never taken; no rows give none.
    """
    rows, parts, drawn = plan(docs, **how)
    lap = _taken(parts, drawn).select("digest", "k", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_docweir_lap"), "first", "stop")
    said = lap.groupBy("digest", "k", "_docweir_lap").agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("_docweir_parts"))
    said = said.withColumnsRenamed({"digest": "_docweir_digest", "k": "_docweir_k"})
    some = docs.withColumn("_docweir_d", _digest("doc_id", "text", "source"))
    here = F.col("_docweir_d") == F.col("_docweir_digest")
    # texts are numbered among rows that are alike only where there are any, as that shuffles them once more
    if not rows.groupBy("digest").count().where("count > 1").isEmpty():
        some = some.withColumn("_docweir_n", F.row_number().over(Window.partitionBy("_docweir_d").orderBy(F.lit(0))))
        here = here & (F.col("_docweir_n") == F.col("_docweir_k"))
    both = some.join(said.hint("merge"), here).select(*[F.col(f"`{c}`") for c in docs.columns], "_docweir_parts")
    out = both.mapInArrow(tidy(_cut, "mixing"), StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
