"""All pairs of a table, against brute force."""

import numpy as np
import pytest

from docweir.operators import closest
from docweir.registry import QUERIES
from tests.conftest import SF


def best(ids, x, k, least):
    x = np.array(x, np.float64)
    s = x @ x.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None] + 1e-9)
    pairs = [(s[i, j], *sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i) if ids[i] != ids[j] and s[i, j] >= least]
    return [(a, b, pytest.approx(v, abs=1e-5)) for v, a, b in sorted(pairs, reverse=True)[:k]]


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = [(r.a, r.b, r.score) for r in QUERIES["fuzzy_pairs"](spark, SF).collect()]
    assert got == best([r.vec_id for r in rows], [r.embedding for r in rows], 60, 0.35) and len(got) == 60


@pytest.mark.parametrize("block", [7, 1024])
def test_blocks(spark, block):
    x = np.random.default_rng(8).normal(size=(60, 5)).round(3)
    x[0] = 0
    ids = [(7 * k) % 61 for k in range(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert [(r.a, r.b, r.score) for r in closest.best_pairs(df, 40, 0.35, size=block).collect()] == best(ids, x, 40, 0.35)
    assert closest.best_pairs(df.limit(0), 40, 0.35).count() == 0


def test_most_pairs_are_left_out(spark):
    """Planted groups of alike vectors: few blocks can reach the score that the blocks themselves have."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    x = np.repeat(centres, 50, 0) + rng.normal(size=(3000, 24)) * 0.03
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    every, met = closest.work(df, 30, 0.35, size=32)
    assert met < 0.1 * every
    assert [(r.a, r.b, r.score) for r in closest.best_pairs(df, 30, 0.35, size=32).collect()] == best(list(range(3000)), x, 30, 0.35)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [2.0]), (None, [1.0, 0.0]), (8, []), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.a, r.b, round(r.score, 4)) for r in closest.best_pairs(df, 10, 0.35).collect()]
    assert sorted(got) == [(1, 2, 0.995), (1, 2, 1.0), (6, 7, 1.0)]
