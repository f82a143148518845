"""Ranked search against plain scoring of every document, and against SQL."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from docweir.llm import lexical_search
from tests.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Rows (item_id, rank, doc_id, score): every document scored for every item."""
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b, n in bags:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(split(text)) if t in b)
            if s > 0:
                scores.append((-s, d is None, d, s))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(400):
        topic = rng.integers(0, 6)
        k = np.minimum(rng.zipf(1.3, rng.integers(1, 60)) - 1, 9) + 10 * topic * (rng.random() < 0.9)
        docs.append((d, " ".join(word[min(x, 59)] for x in k)))
    docs += [(1000 + i, "Common COPY w1, w12-w33") for i in range(80)]  # ties, more than k of them
    docs += [(7, "w1 again"), (7, "w1 again"), (None, "Common copy w1 w12 w33"), (None, None), (9, ""), (9, " .,;"), (11, "Üé w5 日本")]
    items = [(i, " ".join(word[(7 * i + 11 * j) % 60] for j in range(6)) + " W1!") for i in range(20)]
    items += [(3, "common copy"), (3, "common copy"), (None, "w12"), (50, None), (51, "!?"), (52, "nothing of this"), (53, "üé Üé 日本")]
    return docs, items, spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n long"), spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, term string")


@pytest.mark.parametrize(("k", "shard", "block"), [(50, 8192, 64), (5, 32, 4), (1, 7, 1), (600, 100, 16)])
def test_against_plain(corpus, k, shard, block):
    docs, items, d, i = corpus
    ranks, _ = lexical_search.searched(d, i, k, shard=shard, block=block)
    assert rows(ranks) == plain(docs, items, k)


def test_groups_of_items(corpus):
    docs, items, d, i = corpus
    assert rows(lexical_search.searched(d, i, 10, entries=20)[0]) == plain(docs, items, 10)


def test_most_blocks_are_left_out(spark):
    """Items of one topic each: blocks of other topics' documents are left out by their bounds."""
    rng = np.random.default_rng(9)
    docs = []
    for d in range(6000):
        t = d % 60
        docs.append((d, " ".join([*(f"t{t}x{j}" for j in rng.integers(0, 12, 20)), *(f"c{j}" for j in rng.integers(0, 30, 15))])))
    items = [(t, " ".join([*(f"t{t}x{j}" for j in range(6)), *(f"c{j}" for j in range(t % 7))])) for t in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    ranks, blocks = lexical_search.searched(d, i, 5, shard=1500, block=8)
    met, scored = blocks.groupBy().sum().first()
    assert rows(ranks) == plain(docs, items, 5)
    assert scored < 0.6 * met


def test_empty(spark, corpus):
    _, _, d, i = corpus
    assert lexical_search.searched(d.limit(0), i)[0].count() == 0
    assert lexical_search.searched(d, i.limit(0))[0].count() == 0
    assert lexical_search.searched(d.where("text is null"), i.where("text is null"))[0].count() == 0


def test_sql(spark, duck):
    from docweir.llm.queries import ORACLES

    want = duck.execute(ORACLES["op13_lexical_search"]).fetchall()
    assert rows(lexical_search.op13_lexical_search(spark, SF)) == sorted(want, key=str)
