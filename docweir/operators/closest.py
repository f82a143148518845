"""The closest pairs of a table of vectors, without all pairs.

Vectors are sorted by the sides of random planes on which they lie, so that alike ones come together, and cut into
blocks, each with a centre and a radius (of unit vectors). For unit vectors the cosine is 1 - distance ** 2 / 2, so two
blocks have no pair above 1 - max(0, distance of centres - radii) ** 2 / 2.

1. The blocks themselves give a first k-th best score, a lower bound of the last.
2. Parts of blocks have balls, too. Pairs of parts that can't reach the score are left out before any vector
   moves. The others meet in a group each, where pairs of blocks are met from the highest bound down and the
   k-th best so far leaves out the rest.

Scores are exact. With vectors without structure all parts meet, and the work grows with the square of
their number; of the rows k a group are shuffled, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Vectors of a block, blocks of a part (a power of 2), balls of parts that meet in a row, planes.
BLOCK, PART, BALLS, PLANES = 256, 16, 1024, 24
#: What bounds are raised by, for rounding.
SLACK = 1e-6
PAIR, WORK = 0, 1


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    ok = np.isfinite(n) & (n > 0)
    return np.where(ok[:, None], v / np.where(ok, n, 1)[:, None], 0.0)


def _ball(points: np.ndarray, radii: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    c = points.mean(0)
    return c, float((np.linalg.norm(points - c, axis=1) + radii).max())


def _bound(c1: np.ndarray, r1: np.ndarray, c2: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """The highest cosine between vectors of each two balls."""
    d2 = (c1**2).sum(1)[:, None] + (c2**2).sum(1)[None] - 2 * c1 @ c2.T
    gap = np.maximum(0, np.sqrt(np.maximum(d2, 0)) - r1[:, None] - r2[None])
    return 1 - gap**2 / 2 + SLACK


def _cuts(u: np.ndarray, size: int) -> np.ndarray:
    """Where blocks of neighbours begin, and the end: at size vectors, or before a step that is twice the usual one
    once there are size / 8."""
    step = np.linalg.norm(np.diff(u, axis=0), axis=1)
    far = np.append(step > 2 * np.median(step) if len(step) else [], True)
    cuts, least = [0], max(1, size // 8)
    for i in np.flatnonzero(far) + 1:
        while i - cuts[-1] > size:
            cuts.append(cuts[-1] + size)
        if i - cuts[-1] >= least or i == len(u):
            cuts.append(int(i))
    return np.array(cuts)


def _coded(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vec (double), dim and code of each vector; null vectors, null ids and vectors with null components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column(1))
            for dim in pc.unique(n.drop_null()).to_pylist():
                some = b.filter(pc.equal(n, dim))
                v = some.column(1).flatten().cast(pa.float64())
                x = v.to_numpy(zero_copy_only=False).reshape(-1, dim)
                planes = np.random.default_rng(dim).normal(size=(dim, PLANES))
                code = (_unit(x) @ planes > 0) @ (1 << np.arange(PLANES)[::-1])
                keep = pa.array(~np.isnan(x).any(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), lists, pa.array([dim] * len(x), pa.int32()), pa.array(code, pa.int64())], ["id", "vec", "dim", "code"]).filter(keep)

    some = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0))
    return some.select(vec_id, embedding).mapInArrow(run, "id long, vec array<double>, dim int, code long")


def _blocks(rows: DataFrame, vec_id: str, embedding: str, size: int) -> DataFrame:
    """number (in order), dim, ids, vecs, centre and radius of blocks of up to size neighbours."""
    sort = ["dim", "code", "id"]
    near = _coded(rows, vec_id, embedding).repartitionByRange(*sort).sortWithinPartitions(*sort)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in [*batches, None]:
            if b is not None:
                held.append(b)
                if sum(x.num_rows for x in held) < 4 * size:
                    continue
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            dims = t["dim"].to_numpy()
            ends = np.append(np.flatnonzero(np.diff(dims)) + 1, len(dims))
            start, held = 0, []
            for end in ends.tolist():
                dim, last = int(dims[start]), b is None or end < len(dims)
                x = t.slice(start, end - start)["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
                cuts = _cuts(_unit(x), size)
                if not last:
                    cuts = cuts[:-1]  # the rest waits for what follows
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    centre, radius = _ball(_unit(x[i:j]))
                    ids = t["id"].slice(start + i, j - i).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([np.ascontiguousarray(x[i:j]).tobytes()]), pa.array([centre.tobytes()]), pa.array([radius])], ["dim", "ids", "vecs", "centre", "radius"])
                stop = start + int(cuts[-1])
                if stop < end:
                    held = t.slice(stop).to_batches()
                start = end

    return near.mapInArrow(cut, "dim int, ids binary, vecs binary, centre binary, radius double").withColumn("number", F.monotonically_increasing_id())


def _matrix(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    x = np.frombuffer(vecs).reshape(len(i), dim)
    return i, x, np.linalg.norm(x, axis=1)


class _Best:
    """The k best pairs so far; of equal scores the larger a, then the larger b."""

    def __init__(self, k: int, least: float):
        self.k, self.floor = k, least
        self.a, self.b, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, one: tuple, two: tuple, same: bool) -> None:
        (i, x, n), (j, y, m) = one, two
        s = x @ y.T / (n[:, None] * m[None] + 1e-9)
        ok = (s >= self.floor) & (i[:, None] != j[None])
        if same:
            ok &= i[:, None] < j[None]
        p, q = np.nonzero(ok)
        a, b, s = np.minimum(i[p], j[q]), np.maximum(i[p], j[q]), s[p, q]
        if len(s) > self.k:
            some = s >= np.partition(s, -self.k)[-self.k]
            a, b, s = a[some], b[some], s[some]
        self.a, self.b, self.s = np.append(self.a, a), np.append(self.b, b), np.append(self.s, s)
        top = np.lexsort((-self.b, -self.a, -self.s))[: self.k]
        self.a, self.b, self.s = self.a[top], self.b[top], self.s[top]
        if len(self.s) == self.k:
            self.floor = max(self.floor, float(self.s[-1]))


def _first(blocks: DataFrame, k: int, least: float) -> float:
    """The k-th best score inside the blocks, or least if they have fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, least)
        for b in batches:
            for r in b.to_pylist():
                m = _matrix(r["ids"], r["vecs"], r["dim"])
                best.meet(m, m, True)
        yield pa.RecordBatch.from_arrays([pa.array(best.s)], ["score"])

    top = blocks.select("dim", "ids", "vecs").mapInArrow(run, "score double").orderBy(F.desc("score")).limit(k)
    n, last = top.agg(F.count("*"), F.min("score")).first()
    return max(least, last) if n == k else least


def _meetings(blocks: DataFrame, floor: float) -> DataFrame:
    """dim, x <= y: the parts that may have a pair of the score. Balls of parts travel in rows of BALLS, every two of
    which meet."""

    def balls(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        c, r = _ball(np.stack([np.frombuffer(x) for x in pdf["centre"]]), pdf["radius"].to_numpy())
        return pd.DataFrame({"dim": [dim], "part": [int(pdf["part"].iloc[0])], "centre": [c.tobytes()], "radius": [r]})

    each = durable(blocks.select("dim", "part", "centre", "radius").groupBy("dim", "part").applyInPandas(balls, "dim int, part long, centre binary, radius double"), "pair-balls")
    groups = max(1, -(-each.count() // BALLS))
    dealt = each.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = dealt.select("dim", F.least("g", "h").alias("p"), F.greatest("g", "h").alias("q"), "g", "part", "centre", "radius")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        one, two = pdf[pdf["g"] == p], pdf[pdf["g"] == q]
        c1, c2 = (np.stack([np.frombuffer(x) for x in t["centre"]]) if len(t) else np.zeros((0, 1)) for t in (one, two))
        if not len(one) or not len(two):
            return pd.DataFrame({"dim": [], "x": [], "y": []}).astype({"dim": "int32", "x": "int64", "y": "int64"})
        i, j = np.nonzero(_bound(c1, one["radius"].to_numpy(), c2, two["radius"].to_numpy()) >= floor)
        x, y = one["part"].to_numpy()[i], two["part"].to_numpy()[j]
        keep = x <= y if p == q else np.ones(len(x), bool)
        return pd.DataFrame({"dim": np.full(int(keep.sum()), int(pdf["dim"].iloc[0]), np.int32), "x": np.minimum(x, y)[keep], "y": np.maximum(x, y)[keep]})

    return durable(both.groupBy("dim", "p", "q").applyInPandas(near, "dim int, x long, y long"), "pair-parts")


def _found(vectors: DataFrame, k: int, least: float, vec_id: str, embedding: str, size: int) -> tuple[DataFrame, int]:
    """kind, a, b, score and n of the groups' pairs and work, and the number of pairs of blocks."""
    blocks = durable(_blocks(vectors, vec_id, embedding, size), "pair-blocks").withColumn("part", F.floor(F.col("number") / PART))
    per = blocks.groupBy("dim").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]
    floor = _first(blocks, k, least)
    met = _meetings(blocks, floor)
    sides = met.select("dim", "x", "y", F.col("x").alias("part")).union(met.where("x <> y").select("dim", "x", "y", F.col("y").alias("part")))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, dim = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0]), int(pdf["dim"].iloc[0])
        one, two = pdf[pdf["part"] == x], pdf[pdf["part"] == y]
        m1, m2 = ([_matrix(r.ids, r.vecs, dim) for r in t.itertuples()] for t in (one, two))
        c1, c2 = (np.stack([np.frombuffer(v) for v in t["centre"]]) for t in (one, two))
        bound = _bound(c1, one["radius"].to_numpy(), c2, two["radius"].to_numpy())
        if x == y:
            bound[np.tril_indices(len(bound), -1)] = -2
        best, n = _Best(k, floor), 0
        for at in np.argsort(-bound, axis=None, kind="stable").tolist():
            i, j = divmod(at, bound.shape[1])
            if bound[i, j] < best.floor:
                break
            best.meet(m1[i], m2[j], x == y and i == j)
            n += 1
        out = pd.DataFrame({"kind": PAIR, "a": best.a, "b": best.b, "score": best.s, "n": 0})
        return pd.concat([out, pd.DataFrame({"kind": [WORK], "a": [0], "b": [0], "score": [0.0], "n": [n]})])

    dealt = blocks.select("dim", "part", "ids", "vecs", "centre", "radius")
    found = sides.join(dealt, ["dim", "part"]).groupBy("dim", "x", "y").applyInPandas(near, "kind int, a long, b long, score double, n long")
    return durable(found, "pair-found"), int(per or 0)


def best_pairs(vectors: DataFrame, k: int, least: float, vec_id: str = "vec_id", embedding: str = "embedding", size: int = BLOCK) -> DataFrame:
    """a, b, score: of all pairs a < b with a cosine (1e-9 in the denominator) of at least `least`, the k
    best; of equal scores the larger a, then the larger b.

    Vectors meet those of as many components; null ones and those with a null or nan component meet none, a
    zero vector has cosine 0. Rows that repeat an id don't pair with each other. No rows give none.
    """
    found, _ = _found(vectors, k, least, vec_id, embedding, size)
    pairs = found.where(F.col("kind") == PAIR).select("a", "b", "score")
    return pairs.orderBy(F.desc("score"), F.desc("a"), F.desc("b")).limit(k)


def work(vectors: DataFrame, k: int, least: float, vec_id: str = "vec_id", embedding: str = "embedding", size: int = BLOCK) -> tuple[int, int]:
    """How many pairs of blocks there are, and how many were met."""
    found, every = _found(vectors, k, least, vec_id, embedding, size)
    return every, found.where(F.col("kind") == WORK).agg(F.sum("n")).first()[0] or 0
