"""Near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to length 1, so that a cosine of at least t is a distance of at most
epsilon = sqrt(2 - 2t). Equal vectors become one class with a count; only classes are joined.

Classes are projected on the leading principal axes and sorted by their cells of a grid of width
epsilon on the first GRID of these (epsilon grid order), then by id, which cuts a crowded cell too. The
sequence is cut into blocks, within which rows are dealt to tiles by median cuts of the widest axis, and
blocks into a tree of intervals, FAN to a node, with a bounding box for each. Pairs of intervals are
joined recursively from the root, level by level as Spark joins: a pair whose boxes are further apart
than epsilon is left out with all below it. Boxes also bound the length of what the axes leave out, by
which two vectors differ at least. The blocks of pairs that are left meet in parts of several blocks.
There they are halved down to tiles, which are left out if their boxes or their balls (a centre and a
radius in all dimensions) are too far apart. Within a tile the axes and the rest's length bound each
cosine, and only those that may reach t are computed, in double precision. A tile gives counts of links
and a spanning forest of them, never all pairs.

Where vectors have no structure (as random ones in 64 dimensions) no box or ball is far from another:
then all pairs of tiles are bounded, at the cost of AXES components a pair, and hardly any is computed.
work() says how many pairs were left out at each step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, components, durable

AXES, GRID, BLOCK, TILE, FAN = 24, 8, 4096, 128, 16
#: Blocks of a part at most, and how many pairs of parts there are for each core at least, if so many can be.
PART, EACH = 32, 2
#: What rounding in single precision may add to a bound of a cosine.
SLACK = 1e-4


def _width(vectors: DataFrame, embedding: str) -> int:
    """Bytes of a component as it is kept: four for floats, else eight."""
    return 4 if vectors.schema[embedding].dataType.simpleString() == "array<float>" else 8


def _kind(width: int):
    return np.float32 if width == 4 else np.float64


def _prepared(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and key (the components' bytes), null if the vector can link with nothing."""
    width = _width(vectors, embedding)
    kind = _kind(width)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in b.column(1).to_pylist():
            key = None
            if x and None not in x:
                v = np.array(x, kind) + kind(0)  # no negative zero
                if np.isfinite(v).all() and v.any():
                    key = v.tobytes()
            out.append(key)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "key"])

    values = F.col(embedding).cast("array<float>" if width == 4 else "array<double>")
    return arrow_map(vectors, [F.col(vec_id).cast("long").alias("vec_id"), values.alias("v")], run, "vec_id long, key binary")


def _unit(keys: list[bytes], dim: int) -> np.ndarray:
    """Rows of length 1 in double precision. Four bytes a component if the keys are that short."""
    data = b"".join(keys)
    width = len(keys[0]) // dim if len(keys) else 8
    if width not in (4, 8):  # several vectors in one key
        raise ValueError("use _rows for packed keys")
    return _rows(data, dim, width)


def _rows(data: bytes, dim: int, width: int) -> np.ndarray:
    x = np.frombuffer(data, _kind(width)).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _axes(classes: DataFrame, dim: int, k: int) -> np.ndarray:
    """The k leading principal axes of the classes, from sums of products, dim * dim numbers."""

    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(0).to_pylist(), dim)
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(g.ravel())], ["cell", "value"])

    rows = classes.select("key").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    g = np.zeros(dim * dim)
    for r in rows:
        g[r.cell] = r.value
    return np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1][:, :k].copy()


def _places(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and the length of what they leave out."""
    y = x @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", y, y)))
    return np.concatenate([y, rest[:, None]], 1)


def _apart(lo, hi, lo2, hi2) -> float:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float(gap @ gap)


def _in_tiles(y: np.ndarray, tile: int) -> np.ndarray:
    """An order of rows in which every `tile` of them lie close: median cuts of the widest axis."""
    out, stack = [], [np.arange(len(y))]
    while stack:
        rows = stack.pop()
        if len(rows) <= tile:
            out.append(rows)
            continue
        axis = int(np.ptp(y[rows], axis=0).argmax())
        cut = len(rows) // 2 // tile * tile or tile
        rows = rows[np.argsort(y[rows, axis], kind="stable")]
        stack += [rows[cut:], rows[:cut]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class _Tree:
    """Boxes on the axes and balls in all dimensions of the halves of a block, down to tiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.known = x, y, {}
        self.low, self.rest = y[:, :-1].astype(np.float32), y[:, -1].astype(np.float32)

    def bounds(self, a: int, z: int):
        if (a, z) not in self.known:
            x, y = self.x[a:z], self.y[a:z]
            c = x.mean(0)
            self.known[a, z] = y.min(0), y.max(0), c, float(np.sqrt(((x - c) ** 2).sum(1).max()))
        return self.known[a, z]


def _tiles(one: _Tree, two: _Tree, limit: float, same: bool, tile: int):
    """Pairs of intervals of at most tile rows that may hold links, halving the longer interval."""
    stack, far = [(0, len(one.x), 0, len(two.x))], math.sqrt(limit)
    while stack:
        a, z, c, e = stack.pop()
        if same and e <= a:  # a block with itself: each pair once, above the diagonal
            continue
        lo, hi, centre, radius = one.bounds(a, z)
        lo2, hi2, centre2, radius2 = two.bounds(c, e)
        if _apart(lo, hi, lo2, hi2) > limit or np.linalg.norm(centre - centre2) - radius - radius2 > far:
            continue
        if z - a <= tile and e - c <= tile:
            yield a, z, c, e
        elif z - a >= e - c:
            m = a + max(tile, (z - a) // 2 // tile * tile)
            stack += [(a, m, c, e), (m, z, c, e)]
        else:
            m = c + max(tile, (e - c) // 2 // tile * tile)
            stack += [(a, z, c, m), (a, z, m, e)]


def _links(one: _Tree, two: _Tree, a: int, z: int, c: int, e: int, threshold: float) -> tuple[np.ndarray, int]:
    """Which cosines of a tile reach the threshold, and how many of them were computed."""
    bound = one.low[a:z] @ two.low[c:e].T
    bound += one.rest[a:z, None] * two.rest[None, c:e]
    i, j = np.nonzero(bound >= threshold - SLACK)
    m = np.zeros(bound.shape, bool)
    if 4 * len(i) > m.size:
        return one.x[a:z] @ two.x[c:e].T >= threshold, m.size
    m[i, j] = np.einsum("ij,ij->i", one.x[a + i], two.x[c + j]) >= threshold
    return m, len(i)


def _forest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of edges that connect what the true entries of m connect, few of them."""
    r, c = np.nonzero(m)
    if len(r) <= 2 * sum(m.shape):
        return r, c
    out_r, out_c = [], []
    todo = m.any(1)
    free = np.ones(m.shape[1], bool)
    while todo.any():
        rows = np.zeros(len(m), bool)
        rows[np.flatnonzero(todo)[0]] = True
        front = rows.copy()
        while front.any():
            todo &= ~front
            at = np.flatnonzero(front)
            cols = m[at].any(0) & free
            k = np.flatnonzero(cols)
            out_r.append(at[m[at][:, k].argmax(0)])
            out_c.append(k)
            free &= ~cols
            front = m[:, k].any(1) & todo
            at = np.flatnonzero(front)
            if len(at):
                out_r.append(at)
                out_c.append(k[m[at][:, k].argmax(1)])
    return np.concatenate(out_r), np.concatenate(out_c)


#: Kinds of rows that a pair of parts gives: links n of the class a; an edge a, b; pairs a, those that
#: were bounded b, those that were computed n.
LINKS, EDGE, WORK = range(3)


def _joined(pdf, dim: int, width: int, axes: np.ndarray, threshold: float, tile: int):
    """kind, a, b, n of the pairs of blocks of one pair of parts."""
    import pandas as pd

    limit = 2 - 2 * threshold + 1e-6
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    blocks = []
    for r in pdf.itertuples():
        u = _rows(r.keys, dim, width)
        blocks.append((r.part, r.o, np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, np.int64), _Tree(u, _places(u, axes))))
    n = [np.zeros(len(b[2]), np.int64) for b in blocks]
    edges_a, edges_b, pairs, bounded, computed = [], [], 0, 0, 0
    for i, (part, o, ids, count, one) in enumerate(blocks):
        for j, (part2, o2, ids2, count2, two) in enumerate(blocks):
            if part != x or part2 != y or (x == y and o > o2):
                continue
            same = o == o2
            pairs += len(ids) * (len(ids) - 1) // 2 if same else len(ids) * len(ids2)
            for a, z, c, e in _tiles(one, two, limit, same, tile):
                m, some = _links(one, two, a, z, c, e, threshold)
                bounded, computed = bounded + m.size, computed + some
                if same and c < z:
                    m &= np.arange(a, z)[:, None] < np.arange(c, e)[None]
                if not m.any():
                    continue
                n[i][a:z] += m @ count2[c:e]
                n[j][c:e] += count[a:z] @ m
                r, k = _forest(m)
                edges_a.append(ids[a + r])
                edges_b.append(ids2[c + k])
    who, many = np.concatenate([b[2] for b in blocks]), np.concatenate(n)
    who, many = who[many > 0], many[many > 0]
    ea, eb = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (edges_a, edges_b))
    return pd.DataFrame({
        "kind": np.repeat([LINKS, EDGE, WORK], [len(who), len(ea), 1]).astype(np.int32),
        "a": np.concatenate([who, ea, [pairs]]),
        "b": np.concatenate([who, eb, [bounded]]),
        "n": np.concatenate([many, np.zeros(len(ea), np.int64), [computed]]),
    })


def _blocks(classes: DataFrame, dim: int, width: int, axes: np.ndarray, epsilon: float, rows: int) -> DataFrame:
    """Blocks of the sequence: task and number in it (both rising with the sequence), ids, counts, keys, and the box lo0.., hi0.. ."""
    k = axes.shape[1] + 1

    def cells(b: pa.RecordBatch) -> pa.RecordBatch:
        y = _places(_unit(b.column(2).to_pylist(), dim), axes)
        cell = np.floor(y[:, :GRID] / epsilon).astype(np.int32)
        return pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32) * cell.shape[1]), pa.array(cell.ravel()))], ["rep", "n", "key", "cell"])

    def cut(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block(some):
            nonlocal number
            y = _places(_unit([r[2] for r in some], dim), axes)
            some = [some[i] for i in _in_tiles(y, TILE)]
            ids, counts = (np.array([r[i] for r in some], np.int64).tobytes() for i in (0, 1))
            row = {"task": part, "number": number, "ids": ids, "counts": counts, "keys": b"".join(r[2] for r in some)}
            row |= {f"lo{i}": float(v) for i, v in enumerate(y.min(0))} | {f"hi{i}": float(v) for i, v in enumerate(y.max(0))}
            number += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    schema = pa.schema([("task", pa.int64()), ("number", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), *[(f"{s}{i}", pa.float64()) for s in ("lo", "hi") for i in range(k)]])
    spread = arrow_map(classes, ["rep", "n", "key"], cells, "rep long, n long, key binary, cell array<int>")
    # about FAN blocks a partition, cut by range of the grid order
    ordered = spread.repartitionByRange(max(1, -(-rows // (BLOCK * FAN // 2))), "cell", "rep").sortWithinPartitions("cell", "rep").select("rep", "n", "key")
    cuts = durable(ordered.mapInArrow(cut, "task long, number long, ids binary, counts binary, keys binary, " + ", ".join(f"{s}{i} double" for s in ("lo", "hi") for i in range(k))), "blocks")
    # numbers without gaps, from the tasks' counts of blocks
    many = cuts.groupBy("task").agg(F.count("*").alias("many"))
    before = many.withColumn("before", F.sum("many").over(Window.orderBy("task")) - F.col("many"))
    return cuts.join(F.broadcast(before.select("task", "before")), "task").withColumn("o", F.col("before") + F.col("number")).drop("task", "number", "before")


def _near(boxes: DataFrame, k: int, limit: float) -> DataFrame:
    """Pairs a <= b of blocks whose boxes are within the limit, from the root of the tree of intervals."""
    lo, hi = [f"lo{i}" for i in range(k)], [f"hi{i}" for i in range(k)]
    top = boxes.agg(F.max("o")).first()[0] or 0
    levels = max(1, math.ceil(math.log(top + 1, FAN))) if top else 1
    pairs = None
    for level in range(levels - 1, -1, -1):
        size = FAN**level
        at = boxes.groupBy(F.floor(F.col("o") / size).alias("o")).agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi])
        at = at.withColumn("up", F.floor(F.col("o") / FAN))
        a = at.select(F.col("o").alias("a"), F.col("up").alias("pa"), *[F.col(c).alias(f"a_{c}") for c in lo + hi])
        b = at.select(F.col("o").alias("b"), F.col("up").alias("pb"), *[F.col(c).alias(f"b_{c}") for c in lo + hi])
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")), F.lit(2.0)) for i in range(k)), F.lit(0.0))
        if pairs is None:  # the root's children
            both = a.join(b, F.col("pa") == F.col("pb"))
        else:
            both = pairs.join(a, "pa").join(b, "pb")
        pairs = both.where((F.col("a") <= F.col("b")) & (gap <= limit)).select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def join(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors.

    A vector that is null, empty or zero or holds a null or non-finite component links with nothing.
    Vectors link with those of as many components; each such number, of which there are few, is joined
    on its own. A row with a null id isn't compared and has no links and a null component. Each row
    of a repeated id counts as a vector. No rows give none. Other columns are not read.
    """
    rows, usable, width = _usable(vectors, vec_id, embedding)
    classes = None
    for dim in _dims(usable, width):
        some = _linked(*_found(usable.where(F.length("key") == dim * width), dim, width, threshold))
        classes = some if classes is None else classes.union(some)
    return _result(rows, classes)


def work(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """dim, pairs (of different vectors), met (those in blocks that met), bounded (those in tiles that were
    not left out) and computed (those whose cosine was computed) of a join."""
    _, usable, width = _usable(vectors, vec_id, embedding)
    out = None
    for dim in _dims(usable, width):
        classes, found = _found(usable.where(F.length("key") == dim * width), dim, width, threshold)
        n = classes.count()
        some = found.where(F.col("kind") == WORK).agg(F.sum("a").alias("met"), F.sum("b").alias("bounded"), F.sum("n").alias("computed"))
        some = some.select(F.lit(dim).alias("dim"), F.lit(n * (n - 1) // 2).alias("pairs"), "met", "bounded", "computed")
        out = some if out is None else out.union(some)
    return vectors.sparkSession.createDataFrame([], "dim int, pairs long, met long, bounded long, computed long") if out is None else out


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame, int]:
    rows = durable(_prepared(vectors, vec_id, embedding), "vectors")
    return rows, rows.where("key is not null and vec_id is not null"), _width(vectors, embedding)


def _dims(usable: DataFrame, width: int) -> list[int]:
    return sorted(r[0] // width for r in usable.select(F.length("key")).distinct().collect())


def _found(usable: DataFrame, dim: int, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors of dim components (key, first: their least id, n, and rep: a number of the
    class's own, as an id may be repeated with other vectors), and what their join gives (see _joined)."""
    classes = usable.groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    axes = _axes(classes, dim, min(AXES, dim))
    epsilon = math.sqrt(max(2 - 2 * threshold, 1e-12))
    k = axes.shape[1] + 1
    blocks = _blocks(classes, dim, width, axes, epsilon, classes.count())
    boxes = durable(blocks.drop("ids", "counts", "keys"), "boxes")
    many = boxes.count()
    # parts of so many blocks that there is work for all cores: a block is sent once for each part that its own meets
    tile = TILE
    cores = usable.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(PART, many // math.ceil(math.sqrt(2 * EACH * cores))))
    near = _near(boxes, k, 2 - 2 * threshold + 1e-6)
    met = durable(near.select(F.floor(F.col("a") / size).alias("x"), F.floor(F.col("b") / size).alias("y")).distinct(), "parts")
    dealt = blocks.select(F.floor(F.col("o") / size).alias("part"), "o", "ids", "counts", "keys")
    sides = met.select("x", "y", F.col("x").alias("part")).union(met.where("x <> y").select("x", "y", F.col("y").alias("part")))
    found = sides.join(dealt, "part").groupBy("x", "y").applyInPandas(lambda p: _joined(p, dim, width, axes, threshold, tile), "kind int, a long, b long, n long")
    return classes, durable(found, "found")


def _linked(classes: DataFrame, found: DataFrame) -> DataFrame:
    """key, links and component of each class."""
    links = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = durable(components(found.where(F.col("kind") == EDGE).select("a", "b")).withColumnRenamed("id", "rep"), "groups")
    least = durable(groups.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("least")), "least")
    groups = groups.join(least, "component").select("rep", "least")
    classes = classes.join(links, "rep", "left").join(groups, "rep", "left")
    return durable(classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "first").alias("component")), "linked")


def _result(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        rows = rows.withColumn("links", F.lit(0)).withColumn("component", F.col("vec_id"))
    else:
        key = F.when(F.col("vec_id").isNotNull(), F.col("key"))
        rows = rows.select("vec_id", key.alias("key")).join(classes, "key", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
