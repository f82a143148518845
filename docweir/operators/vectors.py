"""Exact vector search in blocks, and fusion of rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunking import top
from .durable import durable

BLOCK = 1024
#: Bytes of query blocks that go to every executor.
BROADCAST = 64 << 20


def cosine(a: str, b: str):
    """With 1e-9 in the denominator, so that a zero vector has cosine 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def _blocks(rows: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """ids and values of up to size vectors a row, all of dim components. Null vectors are left out."""

    def run(batches):
        for b in batches:
            n = pc.list_value_length(b.column(1))
            for dim in pc.unique(n).to_pylist():
                some = b.filter(pc.equal(n, dim))
                for i in range(0, some.num_rows, size):
                    part = some.slice(i, size)
                    v = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).cast(pa.int64()).to_numpy().tobytes()]), pa.array([np.ascontiguousarray(v).tobytes()]), pa.array([dim], pa.int32())], ["ids", "vecs", "dim"])

    return rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col), F.col(vec_col)).mapInArrow(run, "ids binary, vecs binary, dim int")


def _matrix(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vecs).reshape(len(i), dim)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None] + 1e-9)


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by score, then by the smaller id; nan is never among them."""
    score = np.where(np.isnan(score), -np.inf, score)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _found(qi: np.ndarray, best: np.ndarray, who: np.ndarray, least: float | None) -> pa.RecordBatch:
    r, c = np.nonzero(np.isfinite(best) if least is None else best >= least)
    return pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(who[r, c]), pa.array(best[r, c])], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, vec_id: str = "vec_id", embedding: str = "embedding", broadcast: int | None = None, own: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest other vectors of each query by cosine (1e-9 in the
    denominator), those of at least `least` if given. queries: query_id, embedding. own: ids of queries are no
    ids of vectors, so a vector of the same number is another one.

    Blocks of queries are written once. Up to `broadcast` bytes of them (BROADCAST) go to the vectors where
    these lie, and each task keeps the k best of a query; more are joined with the blocks of vectors by
    number, a matrix product each. Either way only k rows a query and task or product are shuffled.
    Vectors meet those of as many components; null ones and those with a null or nan component meet none.
    """
    q = durable(_blocks(queries, "query_id", "embedding", BLOCK).withColumn("number", F.monotonically_increasing_id()), "query-blocks")
    v = _blocks(vectors, vec_id, embedding, BLOCK)
    size = q.agg(F.sum(F.length("vecs") + F.length("ids"))).first()[0] or 0
    if size <= (BROADCAST if broadcast is None else broadcast):
        shared = q.sparkSession.sparkContext.broadcast([(r["ids"], r["vecs"], r["dim"]) for r in q.orderBy("number").collect()])

        def scan(batches):
            blocks = [(_matrix(*r), r[2]) for r in shared.value]
            held: list[tuple | None] = [None] * len(blocks)
            for b in batches:
                for r in b.to_pylist():
                    vi, y = _matrix(r["ids"], r["vecs"], r["dim"])
                    for n, ((qi, x), dim) in enumerate(blocks):
                        if dim != r["dim"]:
                            continue
                        s = _cosines(x, y)
                        if not own:
                            s[qi[:, None] == vi[None]] = -np.inf
                        new = _nearest(s, np.broadcast_to(vi, s.shape), k)
                        held[n] = new if held[n] is None else _nearest(*(np.concatenate([o, w], 1) for o, w in zip(held[n], new, strict=True)), k)
            for ((qi, _), _), best in zip(blocks, held, strict=True):
                if best is not None:
                    yield _found(qi, *best, least)

        found = v.mapInArrow(scan, "query_id long, vec_id long, score double")
    else:
        numbers = [r[0] for r in q.select("number").collect()]  # one for every BLOCK queries
        each = v.withColumn("number", F.explode(F.array(*[F.lit(i) for i in numbers])))
        sides = q.select("number", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "dim")

        def near(batches):
            for b in batches:
                for r in b.to_pylist():
                    (qi, x), (vi, y) = _matrix(r["q_ids"], r["q_vecs"], r["dim"]), _matrix(r["ids"], r["vecs"], r["dim"])
                    s = _cosines(x, y)
                    if not own:
                        s[qi[:, None] == vi[None]] = -np.inf
                    yield _found(qi, *_nearest(s, np.broadcast_to(vi, s.shape), k), least)

        pairs = each.join(sides, ["number", "dim"]).select("q_ids", "q_vecs", "ids", "vecs", "dim")
        found = pairs.mapInArrow(near, "query_id long, vec_id long, score double")
    return top(found, "query_id", F.col("score"), F.col("vec_id"), k)


def normalized(hits: DataFrame) -> DataFrame:
    """score by the largest of its query; a largest of 0 counts as 1."""
    most = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.col("score") / F.coalesce(F.nullif(most, F.lit(0.0)), F.lit(1.0)))


def fuse(dense: DataFrame, keyword: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """query_id, doc_id, score, rank of alpha * dense + (1 - alpha) * keyword, each by the largest of its
    query, a missing side 0, to 4 decimals. Ties go to the smaller id. Both: query_id, doc_id, score."""
    sides = normalized(dense).select("query_id", "doc_id", (F.col("score") * alpha).alias("part")).unionByName(normalized(keyword).select("query_id", "doc_id", (F.col("score") * (1 - alpha)).alias("part")))
    both = sides.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 4).alias("score"))
    return top(both, "query_id", F.col("score"), F.col("doc_id"), k)


def finalize(evidence: DataFrame, top_k: int) -> DataFrame:
    """Of evidence (question_id, subgoal, hop, doc_id, score), the max(2, top_k) best of each sub-goal,
    the first sub-goal's copy of what several have. Within a sub-goal the first hop's copy counts."""
    per = max(2, top_k)
    first = Window.partitionBy("question_id", "subgoal", "doc_id").orderBy("hop", F.desc("score"))
    one = evidence.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    best = Window.partitionBy("question_id", "subgoal").orderBy(F.desc("score"), "doc_id")
    some = one.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per).drop("n")
    copy = Window.partitionBy("question_id", "doc_id").orderBy("subgoal")
    return some.withColumn("n", F.row_number().over(copy)).where("n = 1").drop("n", "hop")


def coverage(evidence: DataFrame, least: float = 0.35) -> DataFrame:
    """question_id, subgoals, satisfied (those with evidence of at least the score), all_satisfied."""
    per = evidence.groupBy("question_id", "subgoal").agg(F.max("score").alias("best"))
    return per.groupBy("question_id").agg(F.count("*").alias("subgoals"), F.count_if(F.col("best") >= least).alias("satisfied"), F.bool_and(F.col("best") >= least).alias("all_satisfied"))


def rerank(hits: DataFrame, top_k: int, by_score: bool = True) -> DataFrame:
    """Of hits (question_id, arrival, chunk_id, score) of several tools, each chunk once as it came first,
    the top_k best by score, or without by_score the first."""
    first = Window.partitionBy("question_id", "chunk_id").orderBy("arrival", F.desc("score"))
    one = hits.where("chunk_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = [*([F.desc("score")] if by_score else []), F.col("arrival"), F.col("chunk_id")]
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rank") <= top_k)
