"""Exact removal of repeated strings by bucket-pointer refinement of sparse suffixes.

Suffixes of all texts are compared by their first `span` bytes: a byte goes if a string of that length
covers it that starts anywhere else, too. Suffixes lie in buckets, which are refined by sorting them on what
stands at other offsets; a bucket of one drops out, and what a round found is what the next one starts from.

Which suffixes are sorted. Of every window of span bytes the q-gram with the least hash (the first of equal
ones) is the anchor. It depends on the window alone, so equal windows have their anchors at the same offset,
and neighbouring windows share theirs: there is an anchor for about every W / 2 bytes, W = span - q + 1.
An anchor stands for its windows, a range of offsets [b1, b2] at which they begin before it.

1. Initial buckets: anchors by their q-gram, sorted on the identifier of the string that all windows of the
   anchor make up. Anchors that agree in both are settled: all their windows are repeated. An anchor alone in
   its bucket has no repeated window.
2. Refinement: what is left, the ends of repeated passages, keeps its string (span + W bytes at most). Its
   range is split by a grid of offsets, and each part gets a bucket, the bytes that all windows of the
   part share (its core), and an identifier, those that any of them has (its union). Sorting settles parts of
   equal core and union, drops those alone in their bucket, and passes the others on to a finer grid, until
   parts are single windows.

Rows are sorted over all partitions by bucket, identifier and place, and a row is compared with its neighbours
only, so a hot bucket is spread over tasks and none is ever held. Where a partition begins or ends inside
a bucket the row goes on to the next round; the last round counts. Identifiers are 64-bit hashes that are
compared inside buckets of 64-bit hashes. Texts are known by 128 bits; texts are shuffled if they may have
a part to refine, and if they may lose bytes, as a sieve of fixed size tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_map, bounded, durable, enter, forget
from .textvec import U, Texts, pieces

SPAN = 200
#: Offsets of a part, round by round.
WIDTHS = (32, 6, 1)
#: Bytes of a text that are looked at together; words of 64 bits of a sieve.
SEGMENT, WORDS = 1 << 22, 1 << 18
_PLACE = U((1 << 24) - 1)


def _gram(span: int) -> int:
    return max(1, span // 5)


def anchors(t: Texts, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of windows: text, place in it, least and greatest offset, bucket and identifier of each anchor."""
    q = _gram(span)
    w = span - q + 1
    for lo in range(0, len(t.buf) - span + 1, SEGMENT):
        raw = t.buf[lo : lo + SEGMENT + span - 1]
        part, n = Texts(raw, np.array([0, len(raw)])), len(raw) - span + 1
        at = np.arange(len(raw) - q + 1)
        h = part.hashes(at, at + q)
        key = (h & ~_PLACE) | at.astype(np.uint64)
        # the least key of each w neighbours: from the left inside blocks of w, from the right inside them
        blocks = np.append(key, np.full(-len(key) % w, ~U(0))).reshape(-1, w)
        left, right = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        s = np.arange(n)
        anchor = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
        doc = np.searchsorted(t.start, lo + s, "right") - 1
        inside = lo + s + span <= t.end[doc]
        s, anchor, doc = s[inside], anchor[inside], doc[inside]
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        if len(first):
            end = np.append(first[1:], len(s))
            p, doc = anchor[first], doc[first]
            b1, b2 = p - s[end - 1], p - s[first]
            yield doc, lo + p - t.start[doc], b1, b2, h[p], part.hashes(p - b2, p - b1 + span)


def _keys() -> list[Column]:
    """128 bits of the text; a null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(17), text).alias("d2")]


def _anchored(docs: DataFrame, span: int) -> DataFrame:
    """d1, d2 and anchors (c, u, at: place, least and greatest offset in one number) of each text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros(b.num_rows, np.int64)
        cols: list[list[np.ndarray]] = [[], [], []]
        for i, j, t in pieces(b, "text"):
            for doc, p, b1, b2, c, u in anchors(t, span):
                counts[i:j] += np.bincount(doc, minlength=j - i)
                for to, v in zip(cols, (c.view(np.int64), u.view(np.int64), p << 24 | b1 << 12 | b2), strict=True):
                    to.append(v)
        flat = [np.concatenate([np.zeros(0, np.int64), *c]) for c in cols]
        items = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["c", "u", "at"])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), items)], ["d1", "d2", "anchors"])

    some = docs.where(F.octet_length("text") >= span)
    return arrow_map(some, [*_keys(), "text"], run, "d1 long, d2 long, anchors array<struct<c:bigint,u:bigint,at:bigint>>", "suffixes")


def _refined(rows: DataFrame, ids: list[str], last: bool = False) -> DataFrame:
    """ids (long), settled and open of each row (c, u, ids) that isn't alone in its bucket c. Settled rows have
    their identifier in common with another. Open rows go to the next round: those that aren't settled, and
    of settled ones with other identifiers beside them in the bucket the first and last, as the others may
    share some windows with them. last: only settled ones."""
    if last:
        twice = durable(rows.groupBy("c", "u").agg(F.count("*").alias("n")).where("n > 1"), "suffix-buckets")
        return rows.join(twice, ["c", "u"]).select(*ids, F.lit(True).alias("settled"), F.lit(False).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffixes")
        held: pa.RecordBatch | None = None  # a row that still lacks its next one, and the one before that
        begun = False
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            yield judged(b, 1 if begun else 0, b.num_rows - 1, begun)
            begun = begun or b.num_rows > 1
            held = b.slice(max(0, b.num_rows - 2))
        if held is not None:  # the partition's last row
            yield judged(held, held.num_rows - 1, held.num_rows, begun)

    def judged(b: pa.RecordBatch, lo: int, hi: int, begun: bool) -> pa.RecordBatch:
        """The rows lo to hi; ends of the partition are open unless a neighbour settles them."""
        c, u = b.column(0).to_numpy(), b.column(1).to_numpy()
        n = len(c)
        bucket = np.zeros(n + 1, bool)
        bucket[1:n] = c[1:] == c[:-1]
        equal = np.zeros(n + 1, bool)
        equal[1:n] = bucket[1:n] & (u[1:] == u[:-1])
        bucket[0], bucket[n] = not begun, hi == n
        settled = equal[:-1] | equal[1:]
        among = (bucket & ~equal)[:-1] | (bucket & ~equal)[1:]  # beside another identifier of the bucket
        rows = np.arange(lo, hi)[(settled | among)[lo:hi]]
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([*[b.column(k + 2).take(at) for k in range(len(ids))], pa.array(settled[rows]), pa.array(among[rows])], [*ids, "settled", "open"])

    dealt = rows.repartitionByRange("c", "u", *ids).sortWithinPartitions("c", "u")
    bounded(rows.sparkSession)
    return dealt.select("c", "u", *ids).mapInArrow(run, ", ".join(f"{x} long" for x in ids) + ", settled boolean, open boolean")


def _sieve(keys: DataFrame) -> Callable[[Column, Column], Column]:
    """Whether d1, d2 may be among keys, by 2 ** 24 bits, whatever the number of keys: with very many of
    them it lets all pass."""
    at = F.explode(F.array("d1", "d2")).alias("h")
    word = keys.select(at).groupBy(F.pmod(F.shiftrightunsigned("h", 6), F.lit(WORDS)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    rows = word.toArrow()
    bits = np.zeros(WORDS, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.arrow_udf("boolean")
    def maybe(d1: pa.Array, d2: pa.Array) -> pa.Array:
        out = True
        for d in (d1, d2):
            h = d.to_numpy().view(np.uint64)
            out = out & ((shared.value[((h >> U(6)) % U(WORDS)).astype(np.int64)] >> (h & U(63)) & U(1)) == 1)
        return pa.array(out)

    return maybe


def _contexts(docs: DataFrame, rows: DataFrame, span: int) -> DataFrame:
    """cid, d1, d2, at and body (the bytes that the windows of an anchor make up) of each row (d1, d2, at)."""
    wanted = durable(rows.groupBy("d1", "d2").agg(F.collect_set("at").alias("ats")), "suffix-open")  # within a text
    maybe = _sieve(wanted)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists = b.column(2).cast(pa.large_binary()), b.column(3)
        row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        at = lists.flatten().to_numpy()
        p, b1, b2 = at >> 24, at >> 12 & 4095, at & 4095
        view = memoryview(texts.buffers()[2] or b"")
        begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][row]
        body = [bytes(view[x:y]) for x, y in zip((begin + p - b2).tolist(), (begin + p - b1 + span).tolist(), strict=True)]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at), pa.array(body, pa.binary())], ["d1", "d2", "at", "body"])

    known = docs.where(F.octet_length("text") >= span).select(*_keys(), "text")
    found = known.where(maybe("d1", "d2")).join(wanted, ["d1", "d2"])
    cut = arrow_map(found, ["d1", "d2", "text", "ats"], run, "d1 long, d2 long, at long, body binary", "suffixes")
    return durable(cut.withColumn("cid", F.monotonically_increasing_id()), "suffix-contexts")


def _parts(contexts: DataFrame, span: int, width: int) -> DataFrame:
    """c, u, cid and e (least and greatest offset in one number) of the parts of a grid of width offsets, of
    each range (ranges: array of such numbers) of contexts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at, lists = b.column(1).to_numpy(), b.column(3)
        off, ranges = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        out = []
        for i, j, t in pieces(b.select(["body"]), "body"):
            own = ranges[off[i] - off[0] : off[j] - off[0]]
            row = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
            e1, e2 = own >> 12, own & 4095
            n = e2 // width - e1 // width + 1
            end = np.cumsum(n)
            k = np.repeat(e1 // width - end + n, n) + np.arange(end[-1] if len(end) else 0)
            row, e1, e2 = np.repeat(row, n), np.maximum(np.repeat(e1, n), k * width), np.minimum(np.repeat(e2, n), k * width + width - 1)
            zero = t.start[row] + (at[i:j] & 4095)[row]  # where the anchor stands
            u = t.hashes(zero - e2, zero - e1 + span)
            first, stop = zero - k * width, zero - np.minimum(k * width + width - 1, span - _gram(span)) + span
            c = t.hashes(first, stop if width > 1 else first + max(1, span // 2))
            out.append((c.view(np.int64), u.view(np.int64), b.column(0).to_numpy()[i:j][row], e1 << 12 | e2))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(4)], ["c", "u", "cid", "e"])

    return arrow_map(contexts, ["cid", "at", "body", "ranges"], run, "c long, u long, cid long, e long", "suffixes")


def repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """d1, d2 and windows of each text that has repeated windows: ranges (first, last) of the places in bytes
    where they begin, not in order. d1, d2: 128 bits of the text."""
    if not 2 <= span < 4096:
        raise ValueError("span must be from 2 to 4095")
    flat = durable(_anchored(docs, span), "suffix-anchors")
    found = durable(_refined(flat.select("d1", "d2", F.explode("anchors").alias("a")).select("a.c", "a.u", "d1", "d2", "a.at"), ["d1", "d2", "at"]), "suffix-found")
    forget(flat)
    contexts = _contexts(docs, found.where("open"), span)
    whole = contexts.withColumn("ranges", F.array(F.expr("at & 16777215")))
    settled = []
    for k, width in enumerate(WIDTHS):
        last = k == len(WIDTHS) - 1
        parts = _parts(whole, span, width)
        step = durable(_refined(durable(parts, "suffix-parts") if last else parts, ["cid", "e"], last), "suffix-refined")
        settled.append(step.where("settled").select("cid", "e"))
        if not last:
            ranges = step.where("open").groupBy("cid").agg(F.collect_set("e").alias("ranges"))  # within an anchor
            whole = contexts.join(ranges, "cid")
    ends = settled[0].union(settled[1]).union(settled[2]).join(contexts.select("cid", "d1", "d2", "at"), "cid")
    at, e = F.col("at"), F.col("e")
    place = F.shiftright(at, 24)
    whole = found.where("settled").select("d1", "d2", (place - F.expr("at & 4095")).alias("first"), (place - F.expr("(at >> 12) & 4095")).alias("last"))
    ends = ends.select("d1", "d2", (place - F.expr("e & 4095")).alias("first"), (place - F.shiftright(e, 12)).alias("last"))
    return durable(whole.union(ends).groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "last")).alias("windows")), "suffix-windows")


def _covered(windows: pa.ListArray, span: int) -> Iterator[np.ndarray]:
    """For each row the maximal ranges of covered bytes, as an array of begin and end."""
    off, flat = windows.offsets.to_numpy(), windows.flatten()
    first, last = (flat.field(k).to_numpy() for k in (0, 1))
    for x, y in zip((off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist(), strict=True):
        order = np.argsort(first[x:y], kind="stable")
        begin, end = first[x:y][order], last[x:y][order] + span
        far = np.maximum.accumulate(end)
        new = np.flatnonzero(np.append(True, begin[1:] > far[:-1])) if len(begin) else np.zeros(0, np.int64)
        yield np.stack([begin[new], far[np.append(new[1:], len(far)) - 1]], 1) if len(begin) else np.zeros((0, 2), np.int64)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    ends = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))


def _split(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that lose nothing, and the others with their windows (an empty list for a few)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("_docweir_row"), *_keys())
    maybe = _sieve(windows)
    hit = keyed.where(maybe("d1", "d2")).join(windows, ["d1", "d2"], "left")
    none = F.array().cast(windows.schema["windows"].dataType)
    fields = [F.col("_docweir_row")[c].alias(c) for c in docs.columns]
    return keyed.where(~maybe("d1", "d2")).select(*fields), hit.select(*fields, F.coalesce("windows", none).alias("_docweir_windows"))


def span_report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and removed (ranges of bytes, begin and end), and the SHA-256 of
    what is kept, of each row of docs.

    A null or empty text has no bytes; texts shorter than span lose nothing. Every row is a document, so
    rows that repeat a text lose all of it (if it has span bytes), whatever their ids; null ids are no
    matter; no rows give none. Other columns are not read.
    """
    slim = docs.select("doc_id", "text")
    clean, hit = _split(slim, repeated(slim, span))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size, gone, kept = [], [], []
        for raw, spans in zip(b.column(1).cast(pa.binary()), _covered(b.column(2), span), strict=True):
            raw = raw.as_py() or b""
            size.append(len(raw))
            gone.append(spans)
            kept.append(hashlib.sha256(_kept(raw, spans)).hexdigest())
        flat = np.concatenate([np.zeros((0, 2), np.int64), *gone])
        n = [len(x) for x in gone]
        removed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"]))
        total = [int((x[:, 1] - x[:, 0]).sum()) for x in gone]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(n, pa.int64()), removed, pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])

    ranges = "array<struct<begin:bigint,end:bigint>>"
    cut = arrow_map(hit, ["doc_id", "text", "_docweir_windows"], run, f"doc_id long, n_bytes long, n_removed long, n_spans long, removed {ranges}, kept_sha256 string", "suffixes")
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    rest = clean.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.array().cast(ranges).alias("removed"), F.sha2(text, 256).alias("kept_sha256"))
    return cut.union(rest)


def without_repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character that loses a byte is replaced by U+FFFD
    where the rest isn't UTF-8. n_chars, if there, is counted anew.

    Every row and column stays, also a text that becomes empty. Null and empty texts stay as they are; rows
    that repeat a text all lose it; no rows give none.
    """
    clean, hit = _split(docs, repeated(docs.select("text"), span))
    names = docs.columns
    k = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("suffixes")
        for b in batches:
            if b.num_rows:
                rows = zip(b.column(k).cast(pa.binary()), _covered(b.column(b.num_columns - 1), span), strict=True)
                out = [None if raw.as_py() is None else _kept(raw.as_py(), spans).decode("utf-8", "replace") for raw, spans in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if j == k else b.column(j) for j in range(len(names))], names)

    bounded(docs.sparkSession)
    out = hit.mapInArrow(run, StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields])).union(clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
