"""Line dedup by content-defined chunks.

A document's lines are split at line feeds. From every line that has words the shortest run of lines
with at least MIN_WORDS words is a chunk, and so is the shortest such run up to it, however many lines that
takes. A chunk depends on its own lines alone, so any passage of whole lines and at least MIN_WORDS
words has the same chunks wherever it stands, and they cover all of it: its first line begins one, its
last line ends one, and each line after the first chunk ends one too. Chunks overlap. Two characters of
scripts that are written without spaces count as a word. A line is in MIN_WORDS chunks of each kind at
most, as every one begins or ends at a line of its own that has a word.

A chunk that stands in the corpus twice or more is removed everywhere but at its first place, by
document id and then position. A removed line thus always has an equal one at an earlier place. Hashes
only find the candidates: the bytes of each are compared with those of the first place before anything
is removed.

Hashes are shuffled for all chunks, and counted for each task first. Texts are shuffled once, by id and
digest, to the chunks of theirs whose hash repeats, and once more to be cut; the bytes of a chunk are
written only where its hash repeats. A hot chunk's rows meet one row of the other side, so that
adaptive execution can split them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import bounded, durable, forget, tidy
from .textvec import Texts, pieces

MIN_WORDS = 20
#: First bytes of characters that are written without spaces: kana and CJK ideographs; Thai, Lao and Khmer by two.
_SOLID = np.zeros(256, bool)
_SOLID[0xE3:0xEA] = True

_SPAN = StructType([StructField("chunk", IntegerType()), StructField("hash", LongType()), StructField("line", IntegerType()), StructField("lines", IntegerType()), StructField("start", LongType()), StructField("stop", LongType())])


def solid(t: Texts, start: np.ndarray) -> np.ndarray:
    """Words of each line (by its first byte) that no space tells: half its characters of scripts without."""
    b = t.buf
    flags = _SOLID[b]
    flags[:-1] |= (b[:-1] == 0xE0) & (b[1:] >= 0xB8) & (b[1:] <= 0xBB) | (b[:-1] == 0xE1) & (b[1:] >= 0x9E) & (b[1:] <= 0x9F)
    return np.add.reduceat(flags, start, dtype=np.int64) // 2 if len(start) else np.zeros(0, np.int64)


def chunks(batch: pa.RecordBatch, name: str = "text", min_words: int = MIN_WORDS):
    """For runs of rows: row, number in its row, hash, lines, words, first and last+1 byte of each
    chunk, with the Texts; and the rows' numbers of lines."""
    for i, j, t in pieces(batch, name):
        doc, s, e = t.lines()
        _, ws, _ = t.words()
        words = np.bincount(np.searchsorted(s, ws, "right") - 1, minlength=len(s)) + solid(t, s)
        upto = np.concatenate([[0], np.cumsum(words)])
        some = np.flatnonzero(words)
        # the shortest runs from and up to each line; as upto rises at lines with words, those are their ends
        first = np.concatenate([some, np.searchsorted(upto, upto[some + 1] - min_words, "right") - 1])
        end = np.concatenate([np.searchsorted(upto, upto[some] + min_words) - 1, some])
        ok = (first >= 0) & (end < len(s))
        ok[ok] = doc[first[ok]] == doc[end[ok]]
        first, end = np.divmod(np.unique(first[ok] * len(s) + end[ok]), max(1, len(s)))
        d, start, stop = doc[first], s[first], e[end]
        number = np.arange(len(first)) - np.searchsorted(d, d)
        yield i, j, t, d, number, t.hashes(start, stop), end - first + 1, upto[end + 1] - upto[first], start, stop, np.bincount(doc, minlength=j - i)


def _spans(batch: pa.RecordBatch, min_words: int) -> tuple[pa.Array, pa.Array]:
    """For each row the chunks that may be removed, positions in bytes of the text; and its lines."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    counts = np.zeros(batch.num_rows, np.int64)
    n_lines = np.zeros(batch.num_rows, np.int64)
    for i, j, t, d, number, h, lines, total, start, stop, per_row in chunks(batch, min_words=min_words):
        begins = t.lines()[1]
        line = np.searchsorted(begins, start) - np.searchsorted(begins, t.start[d])
        for c, v in zip(cols, (number, h.view(np.int64), line, lines, start - t.start[d], stop - t.start[d]), strict=True):
            c.append(v)
        counts[i:j] = np.bincount(d, minlength=j - i)
        n_lines[i:j] = per_row
    if batch.num_rows:
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
    else:
        flat = [np.zeros(0, np.int64)] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    values = pa.StructArray.from_arrays([pa.array(v).cast(k) for v, k in zip(flat, kinds, strict=True)], names=_SPAN.names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values), pa.array(n_lines)


def _spanned(docs: DataFrame, columns: list[str], min_words: int) -> DataFrame:
    """The columns (text is dropped) with spans and n_lines."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                spans, n = _spans(b, min_words)
                rest = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], spans, n], [*rest, "spans", "n_lines"])

    fields = [f for f in docs.select(*columns).schema.fields]
    schema = StructType([*fields, StructField("spans", ArrayType(_SPAN)), StructField("n_lines", LongType())])
    return docs.select(*columns, "text").mapInArrow(tidy(run, "lines"), schema)


def _digest(text: str = "text") -> Column:
    """128 bits that tell the texts of a repeated id apart."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(all, gone). all: doc_id, digest (of the text) and n_lines of each row; gone: doc_id, digest, chunk,
    start, stop (bytes of the text), line (its first), lines of each chunk that an earlier place repeats
    byte for byte.

    A place is an id, a text and a position: rows that repeat an id and a text are one place, rows of one
    id with different texts are several, in the order of their digests. Rows with a null id or text take
    no part; no rows give none.
    """
    bounded(docs.sparkSession)
    known = docs.select("doc_id", _digest().alias("digest"), "text")
    all_spans = durable(_spanned(known, ["doc_id", "digest"], min_words), "chunks")
    flat = all_spans.where("doc_id is not null").select("doc_id", "digest", F.explode("spans").alias("c")).select("doc_id", "digest", "c.*")
    # aggregates are written before their joins, so that adaptive execution can split a hot chunk's rows
    seen = durable(flat.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"), "repeated")
    hits = durable(flat.join(seen.drop("n"), "hash"), "hits")
    # the first place: the least doc_id, there the least digest, there the least chunk
    place = durable(hits.where("doc_id = first_id").groupBy("hash").agg(F.min(F.struct("digest", "chunk")).alias("first")), "places")
    is_first = (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first.digest")) & (F.col("chunk") == F.col("first.chunk"))
    marked = hits.join(place, "hash").withColumn("is_first", is_first)
    wanted = marked.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("chunk", "hash", "start", "stop", "line", "lines", "is_first"))).alias("w"))
    # a document's own chunks, at most twice as many as its lines, with the bytes of each

    def cut_out(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts, w = b.column(2), b.column(3)
            lists, off = w.flatten(), np.diff(w.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), off)
            raw = texts.cast(pa.large_binary())
            start, stop = lists.field("start").to_numpy(), lists.field("stop").to_numpy()
            data, offsets = np.frombuffer(raw.buffers()[2] or b"", np.uint8), np.frombuffer(raw.buffers()[1], np.int64)[raw.offset :]
            view = memoryview(data)
            base = offsets[row]
            body = pa.array([bytes(view[x:y]) for x, y in zip(base + start, base + stop, strict=True)], pa.binary())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[lists.field(c) for c in ("chunk", "hash", "start", "stop", "line", "lines", "is_first")], body], ["doc_id", "digest", "chunk", "hash", "start", "stop", "line", "lines", "is_first", "body"])

    bodies = known.join(wanted, ["doc_id", "digest"]).select("doc_id", "digest", "text", "w")
    bodies = durable(bodies.mapInArrow(tidy(cut_out, "lines"), "doc_id long, digest binary, chunk int, hash long, start long, stop long, line int, lines int, is_first boolean, body binary"), "bodies")
    firsts = durable(bodies.where("is_first").select("hash", F.col("body").alias("first_body")).distinct(), "firsts")
    gone = bodies.where("not is_first").join(firsts, "hash").where("body = first_body")
    gone = durable(gone.select("doc_id", "digest", "chunk", "start", "stop", "line", "lines").distinct(), "gone")
    for t in (seen, hits, place, bodies, firsts):
        forget(t)
    return all_spans.select("doc_id", "digest", "n_lines"), gone


def _strip(batches):
    """Texts without the given byte ranges, which may overlap, each with the line feed that follows it, or at the end of
    the text with the one before it."""
    for b in batches:
        if not b.num_rows:
            continue
        text, cuts = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("_docweir_cuts"))
        out = []
        for t, c in zip(text, cuts, strict=True):
            c = c.as_py()
            if not c:
                out.append(t.as_py())
                continue
            raw, kept, at = t.as_py().encode(), [], 0
            for x in c:
                if x["start"] > at:
                    kept.append(raw[at : x["start"]])
                at = max(at, x["stop"] + 1)
            kept.append(raw[at:])
            if at > len(raw) and at > 0 and b"".join(kept[-2:-1]).endswith(b"\n"):
                kept[-2] = kept[-2][:-1]  # the text's last line went: so does the line feed before it
            out.append(b"".join(kept).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_docweir_cuts"], [n for n in b.schema.names if n != "_docweir_cuts"])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated chunks taken out of text (and n_chars, if there, counted anew).

    Every row stays, also one whose text becomes empty; other columns stay as they are. A row is cut by
    the ranges of its own id and text, so that of an id with several texts each loses what is its own.
    Null and empty texts and rows with a null id stay as they are; no rows give none.
    """
    _, gone = repeats(docs, min_words)
    cuts = gone.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_docweir_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_docweir_id"), F.col("digest").alias("_docweir_digest"), "_docweir_cuts")
    joined = docs.join(cuts, (docs["doc_id"] == F.col("_docweir_id")) & (_digest() == F.col("_docweir_digest")), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "_docweir_cuts")
    out = joined.mapInArrow(tidy(_strip, "lines"), StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def _covered(runs: Column) -> Column:
    """How many lines runs (line, lines), in order, cover."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state, r):
        end = F.greatest(state["end"], r["line"] + r["lines"])
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(state["end"], F.least(r["line"], end))).alias("n"))

    return F.aggregate(runs, none, add, lambda state: state["n"])


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed (lines) and removed (byte ranges in order, which may overlap) of each row of docs.

    A null or empty text has one empty line and loses nothing; a row with a null doc_id loses
    nothing and lends nothing; rows that repeat an id and a text are one place and have the same ranges,
    rows that repeat an id with another text have their own; no rows give none. Other columns are not read.
    """
    lines, gone = repeats(docs, min_words)
    cuts = gone.groupBy("doc_id", "digest").agg(_covered(F.sort_array(F.collect_list(F.struct("line", "lines")))).alias("n_removed"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    out = lines.join(cuts, ["doc_id", "digest"], "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
