"""Packing token ids into sequences of a fixed length.

Documents longer than LENGTH are split into pieces of that length and a rest, so nothing is lost.
Pieces are packed best-fit decreasing: longest first, each into the sequence with the least room
that still holds it. A segment tree over the amounts of room finds it: its leaves count the open
sequences with just that much room, and the search goes to the leftmost one that isn't empty from
the piece's length on. The batches of a partition are packed in groups of about GROUP tokens, so
that memory is bounded, no token is shuffled, and a lost task packs its own rows again.

A packed row holds its ids as little-endian 32-bit integers, the cumulative lengths of its segments
(0 first) and positions that start at 0 in each segment; `write` adds padding to make whole matrices.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, GROUP = 2048, 4_000_000

PACKED = "doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class Rooms:
    """A segment tree over room 0..size: how many open sequences have just that much room."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, number: int) -> None:
        self.open.setdefault(room, []).append(number)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        at = room + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """An open sequence with the least room of at least need, and its room; it is closed."""
        at, count = need + self.base, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to the first right neighbour with one
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at *= 2
                at += not count[at]
        room = at - self.base
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """The pieces (their numbers) of each sequence, for sizes of 1..length."""
    rooms, bins = Rooms(length), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[k])
        found = rooms.take(need) if need < length else None
        if found is None:
            found = (len(bins), length)
            bins.append([])
        bins[found[0]].append(k)
        if found[1] > need:
            rooms.put(found[1] - need, found[0])
    return bins


def _pack(ids: list[np.ndarray], docs: list[int | None], length: int) -> pa.RecordBatch:
    pieces = [(d, s) for d, v in enumerate(ids) for s in range(0, len(v), length)]
    sizes = np.array([min(length, len(ids[d]) - s) for d, s in pieces], np.int64)
    rows = []
    for some in best_fit(sizes, length):
        parts = [ids[pieces[k][0]][pieces[k][1] : pieces[k][1] + length] for k in some]
        n = sizes[some]
        rows.append({
            "doc_ids": [docs[pieces[k][0]] for k in some],
            "starts": [pieces[k][1] for k in some],
            "cu_seqlens": np.concatenate([[0], np.cumsum(n)]).tolist(),
            "n_tokens": int(n.sum()),
            "ids": np.concatenate(parts).astype("<u4").tobytes(),
            "positions": np.concatenate([np.arange(x) for x in n]).astype("<u4").tobytes(),
        })
    return pa.RecordBatch.from_pylist(rows, pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary())]))


def _grouped(rows: Iterator[tuple[int | None, np.ndarray]], length: int, group: int) -> Iterator[pa.RecordBatch]:
    docs, ids, total = [], [], 0
    for d, v in rows:
        if len(v):
            docs.append(d)
            ids.append(v)
            total += len(v)
        if total >= group:
            yield _pack(ids, docs, length)
            docs, ids, total = [], [], 0
    if docs:
        yield _pack(ids, docs, length)


def packed(tokens: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Packed rows of tokens (doc_id, ids array<int>): doc_ids and starts (where in its document each
    segment begins), cu_seqlens, n_tokens, ids, positions.

    Rows with null or empty ids give nothing; a null doc_id stays null in doc_ids; repeated rows are
    packed each; no rows give none. How rows meet in a sequence depends on Spark's partitions, what
    is packed does not.
    """

    def run(batches):
        def rows():
            for b in batches:
                lists, flat = b.column(1), b.column(1).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.nan_to_num(np.array([len(x) if x.is_valid else 0 for x in lists])))
                for k, d in enumerate(b.column(0).to_pylist()):
                    yield d, flat[ends[k - 1] if k else 0 : ends[k]].astype(np.uint32)

        yield from _grouped(rows(), length, group)

    return tokens.select("doc_id", "ids").mapInArrow(run, PACKED)


def packed_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, length: int = LENGTH, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """packed() of the texts' ids by a vocabulary of ranks, encoded and packed in the same task.

    A null text counts as empty and gives nothing.
    """
    from .bpe import _texts, _vocabulary

    voc = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches):
        encode = _encoder(*voc.value)

        def rows():
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), _texts(b, "text"), strict=True):
                    yield d, np.array(encode(t), np.uint32)

        yield from _grouped(rows(), length, group)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKED)


_encoders: dict[str, object] = {}


def _encoder(ranks_file: bytes, pattern: str):
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x.strip())}
        _encoders[key] = tiktoken.Encoding(key[:8], pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[key]


def write(rows: DataFrame, path: str, length: int = LENGTH, rows_per_matrix: int = 256, pad: int = 0) -> None:
    """Parquet files of matrices of ids and positions (rows_per_matrix x length little-endian 32-bit
    integers, the last of a partition smaller, padded with pad) with each row's cu_seqlens, doc_ids, starts."""
    kinds = [("n_rows", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("starts", pa.list_(pa.list_(pa.int64())))]

    def matrix(some):
        def whole(c):
            m = np.full((len(some), length), pad, "<u4")
            for k, r in enumerate(some):
                v = np.frombuffer(r[c], "<u4")
                m[k, : len(v)] = v
            return m.tobytes()

        row = {"n_rows": len(some), "ids": whole("ids"), "positions": whole("positions")} | {c: [r[c] for r in some] for c in ("cu_seqlens", "doc_ids", "starts")}
        return pa.RecordBatch.from_pylist([row], pa.schema(kinds))

    def run(batches):
        held = []
        for b in batches:
            held += b.to_pylist()
            while len(held) >= rows_per_matrix:
                yield matrix(held[:rows_per_matrix])
                held = held[rows_per_matrix:]
        if held:
            yield matrix(held)

    rows.mapInArrow(run, "n_rows int, ids binary, positions binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, starts array<array<long>>").write.parquet(path)


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed sequence of documents, with digests for the two matrices' rows."""
    rows = packed_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_ids", "starts", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
