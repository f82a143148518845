"""Periodic runs against the method word by word, with every earlier occurrence."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweir.llm import periodic_runs


def plain(words, least=6, power=4):
    """(start, length, period) of every run: each word increments the lags of all its earlier occurrences."""
    out, seen, active = [], {}, {}
    for i in range(len(words) + 1):
        now = {i - j: active.get(i - j, 0) + 1 for j in seen.get(words[i], [])} if i < len(words) else {}
        if i < len(words):
            seen.setdefault(words[i], []).append(i)
        for q, n in active.items():
            if q not in now and n + q >= max(least, power * q):
                run = words[i - n - q : i]
                if not any(all(run[x] == run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                    out.append((i - n - q, n + q, q))
        active = now
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(docs, **more):
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    word = np.array([x for d in docs for x in d], np.uint64)
    begin = np.append(0, np.cumsum([len(d) for d in docs]))
    first, length, period = periodic_runs.find_runs(doc, word, **more)
    at = np.searchsorted(begin, first, "right") - 1
    return [[(int(f - begin[d]), int(n), int(q)) for f, n, q, k in zip(first, length, period, at, strict=True) if k == d] for d in range(len(docs))]


@st.composite
def texts(draw):
    """Words of a small vocabulary, with a periodic stretch, perhaps broken at one word."""
    head, unit, tail = (draw(st.lists(st.integers(0, 2), max_size=n)) for n in (12, 40, 12))
    body = (unit * 9)[: draw(st.integers(0, 9 * len(unit)))] if unit else []
    out = head + body + tail
    if out and draw(st.booleans()):
        out[draw(st.integers(0, len(out) - 1))] = 9
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(texts(), min_size=1, max_size=3))
def test_runs(docs):
    assert found(docs) == [plain(d) for d in docs]
    assert found(docs, least=2, power=3) == [plain(d, 2, 3) for d in docs]


def test_long_runs():
    rng = np.random.default_rng(5)
    for q in (1, 2, 7, 8, 9, 16, 17, 31, 32, 33, 64, 65, 250):
        unit = rng.permutation(10_000)[:q].tolist()
        for n in (4 * q - 1, 4 * q, 5 * q + 3):
            words = [10_001, *(unit * 9)[: max(n, 6)], 10_002]
            assert found([words]) == [[(1, max(n, 6), q)] if max(n, 6) >= 4 * q else []]
    assert found([[7] * 200_000]) == [[(0, 200_000, 1)]]  # not quadratic
    with pytest.raises(ValueError, match="power"):
        found([[1]], power=2)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(key, text, plant=True):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digests(spark):
    rows = [(k, f"it says {'no ' * (k % 9)}and then\n{'so it goes \t' * (k % 7)}on and on {'x' * (k % 50 == 0) * 3000}é{k}" * (1 + k % 3)) for k in range(300)]
    rows += [(None, "a b a b a b a b a b"), (7, None), (7, ""), (7, " \n"), (40, "one"), (40, "one"), (41, "go " * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string")
    got = periodic_runs.run_digests(df, plant=True).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k, *expected(k, t))) for k, t in rows)
    assert periodic_runs.run_digests(df.limit(0)).collect() == []


def test_query_plants(spark, duck):
    from docweir.llm.queries import ORACLES
    from tests.conftest import SF

    got = periodic_runs.op12_periodic_runs(spark, SF)
    want = duck.execute(ORACLES["op12_periodic_runs"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda df: sorted(df[sorted(df.columns)].astype(object).where(df.notna(), "-").map(lambda v: str(int(v)) if isinstance(v, float) else str(v)).values.tolist())
    assert shown(got.toPandas()) == shown(want)
    assert sum(r["n_runs"] > 0 for r in got.collect()) > 10


def test_operators(spark, odd):
    r = periodic_runs.runs(odd)
    assert r.count() == odd.count() and r.dtypes[2][1] == "array<struct<start:bigint,length:bigint,period:bigint>>"
    assert {(x["doc_id"], x["n_words"]) for x in r.collect()} >= {(3, 0), (4, 0), (5, 0), (6, 2), (9, 1)}
    out = periodic_runs.collapse(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))  # no runs there
    noisy = spark.createDataFrame([(1, "start " + "la di da " * 9 + "end", "x"), (2, "kept  as\tit is", None)], "id long, text string, doc_id string")
    assert [x["text"] for x in periodic_runs.collapse(noisy).orderBy("id").collect()] == ["start la di da end", "kept  as\tit is"]
    assert periodic_runs.collapse(noisy.limit(0)).count() == 0
