"""The grid order join against brute force on planted clusters, and how much of the work it leaves out."""

import time

import numpy as np
import pytest

from docweir.llm import embedding_join

from .test_brute_force import groups


def planted(n, dim=64, size=25, spread=0.02, seed=0, alone=0.5):
    """Clusters of vectors that link, far from each other; and a share of vectors on their own."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(int(n * (1 - alone)) // size, dim)) * np.exp(-np.arange(dim) / 6)
    near = np.repeat(centres, size, 0) + rng.normal(size=(len(centres) * size, dim)) * spread * np.linalg.norm(centres, axis=1).mean() / dim**0.5
    alone = rng.normal(size=(n - len(near), dim)) * np.exp(-np.arange(dim) / 6)
    return np.concatenate([near, alone]).astype(np.float32)[rng.permutation(n)]


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("tile", [16, 128])
def test_planted_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_join, "BLOCK", 256)
    monkeypatch.setattr(embedding_join, "TILE", tile)
    x = planted(1500)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = groups(range(len(x)), list(zip(*map(list, np.nonzero(np.triu(near, 1))), strict=True)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.join(frame(spark, x)).collect()}
    assert got == {k: (int(near[k].sum()) - 1, want[k]) for k in range(len(x))} and near.sum() > 10 * len(x)


def test_most_work_is_left_out(spark):
    """Of clustered vectors few tiles meet, and the cosines that are computed are those of the clusters: about
    as many a vector at any size."""
    rates = {}
    for n in (4000, 16000):
        w = embedding_join.work(frame(spark, planted(n, size=200, alone=0.05))).first()
        rates[n] = w
        assert w.pairs == n * (n - 1) // 2
    assert rates[16000].bounded < 0.5 * rates[16000].pairs and rates[16000].computed < 0.04 * rates[16000].pairs
    assert rates[16000].computed < 5 * rates[4000].computed


def test_random_vectors_are_bounded(spark):
    """Vectors without structure: tiles meet, but hardly any cosine is computed."""
    x = np.random.default_rng(1).normal(size=(4000, 64)).astype(np.float32)
    began = time.time()
    w = embedding_join.work(frame(spark, x)).first()
    assert w.computed < 0.01 * w.pairs and time.time() - began < 120


def test_doubles(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1 + 1e-12, 0.2]), (3, [0.2, -0.1]), (4, [1e300, 2e300]), (5, [1e-320, 2e-320])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == got[2] == (3, 1) and got[4][1] == 1 and got[3] == (0, 3)
