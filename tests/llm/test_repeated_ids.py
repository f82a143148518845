"""One id with several texts, and stages one after the other with clashing columns."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from docweir.llm import embedding_join, jaccard_join, line_dedup, mixing, quality_rules

from .conftest import prose

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids that repeat with other texts (null and multi-byte ones among them), and whole rows that repeat."""
    p = "\n".join(prose(k, 30) for k in range(6))
    rows = [
        (1, p, "en", "a"), (2, "start\n" + p, "en", "a"), (2, None, "en", "a"), (2, "日本é " * 60 + "\n" + prose(9, 70), "fr", "a"), (2, "start\n" + p, "en", "a"),
        (3, "é" + p[1:], "en", None), (3, p + "\nend", "en", "b"), (None, p, "en", "b"), (None, prose(40, 90), "en", "b"), (4, "", None, "b"), (5, prose(50, 90), "en", "c"), (5, prose(50, 90), "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def test_lines_of_each_text(repeated):
    rows = repeated.collect()
    first = rows[0].text
    got = line_dedup.without_repeats(repeated.withColumn("place", F.monotonically_increasing_id())).orderBy("place").collect()
    by = Counter((r.doc_id, r.text) for r in got)
    assert len(got) == len(rows) and by[(1, first)] == 1 and by[(2, None)] == 1 and by[(2, "start")] == 2
    assert by[(2, rows[3].text)] == 1 and by[(3, "end")] == 1 and by[(None, first)] == 1
    assert by[(3, rows[5].text.split("\n")[0])] == 1 and by[(5, rows[10].text)] == 2
    report = Counter((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.line_report(repeated).collect())
    assert report[(2, 7, 6)] == 2 and report[(2, 1, 0)] == 1 and report[(3, 7, 6)] == 1 and report[(3, 6, 5)] == 1


def test_mixing_of_each_text(repeated):
    report, out = mixing.mix_report(repeated).collect(), mixing.mixed(repeated).collect()
    assert len(report) == repeated.count() and all(0 <= r.taken <= 2 * r["size"] for r in report)
    assert sum(r.taken for r in report) == sum(len(re.findall(WORD, r.text)) for r in out)
    per = Counter()
    for r in out:
        per[r.doc_id] += len(re.findall(WORD, r.text))
    want = Counter()
    for r in report:
        want[r.doc_id] += r.taken
    assert +per == +want
    given = {w for r in repeated.collect() for w in re.findall(WORD, r.text or "")}
    assert {w for r in out for w in re.findall(WORD, r.text)} <= given


def test_shards_hold_the_mix(repeated):
    """Slots of all shards hold as many words as the report says, block by block."""
    rows = mixing.shard_blocks(repeated, per_shard=4).collect()
    assert len({r.shard for r in rows}) > 2 and sorted(len(r.words.split()) <= mixing.BLOCK for r in rows)[0]
    assert sum(len(r.words.split(" ")) for r in rows) == sum(r.taken for r in mixing.mix_report(repeated, per_shard=4).collect())
    again = mixing.shard_blocks(repeated, per_shard=4).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


@pytest.mark.parametrize("per_shard", [3, 50, 10**6])
def test_draws(per_shard):
    quota = np.array([40, 0, 7, 100])
    rows = mixing.draws(quota, per_shard)
    for s, q in enumerate(quota):
        own = [(first, n) for _, t, first, n in rows if t == s]
        assert [k for first, n in own for k in range(first, first + n)] == list(range(q))
    assert mixing.draws(np.zeros(3, np.int64)) == []


def test_slots_against_plain(spark):
    quota, blocks = np.array([40, 7, 100]), np.array([20, 7, 64])
    drawn = mixing.draws(quota, 10)
    got = sorted((r.s, r.slot, r.shard, r.block) for r in mixing.slots(spark, drawn, blocks).collect())
    shard = {(s, first + i): k for k, s, first, n in drawn for i in range(n)}
    assert [(s, slot) for s, slot, _, _ in got] == [(s, k) for s, q in enumerate(quota) for k in range(q)]
    assert all(shard[s, slot] == k for s, slot, k, _ in got)
    for s, n in enumerate(blocks):  # each lap takes every block once
        took = [b for t, _, _, b in got if t == s]
        for lap in range(0, len(took), n):
            assert len(set(took[lap : lap + n])) == len(took[lap : lap + n]) and max(took) < n


def test_jaccard_of_repeated_ids(repeated):
    got = {r.doc_id for r in jaccard_join.join(repeated).collect()}
    assert got == {r.doc_id for r in repeated.select("doc_id").collect()}


def test_stages_one_after_the_other(odd, repeated, spark):
    """Each stage on the output of the one before, with columns that clash with names inside the operators."""
    extra = [c for c in odd.columns if c not in repeated.columns]
    more = odd.unionByName(repeated.select("*", *[odd.schema[c].dataType.typeName() and F.lit(None).cast(odd.schema[c].dataType).alias(c) for c in extra]))
    docs = more
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == more.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0, name


def plain_dawid_skene(votes, rounds=200):
    """Two classes, started by majority; the posterior of the class with fewer bad votes."""
    bad = votes == 0
    p = np.where(bad.mean(1) >= 0.5, 0.1, 0.9)
    for _ in range(rounds):
        prior = p.mean()
        like = []
        for w in (p, 1 - p):
            rate = np.stack([((votes == v) * w[:, None]).sum(0) + 0.5 for v in range(3)]) / (w.sum() + 1.5)
            like.append(sum(np.log(rate[votes[:, r], r]) for r in range(votes.shape[1])))
        d = np.clip(np.log(prior) + like[0] - np.log(1 - prior) - like[1], -500, 500)
        p = 1 / (1 + np.exp(-d))
    return p


@pytest.mark.parametrize(("caught", "alarms", "share"), [(0.6, 0.01, 0.2), (0.4, 0.03, 0.3), (0.7, 0.05, 0.1)])
def test_noisy_rule_is_outvoted(caught, alarms, share):
    rng, n = np.random.default_rng(int(100 * caught)), 8000
    is_bad = rng.random(n) < share
    votes = np.where(rng.random((n, 9)) < np.where(is_bad[:, None], caught, alarms), 0, np.where(rng.random((n, 9)) < 0.8, 2, 1))
    votes[:, 3] = np.where(rng.random(n) < np.where(is_bad, caught, 0.2), 0, np.maximum(votes[:, 3], 1))
    key = (votes * 3 ** np.arange(9)).sum(1).tolist()
    est = quality_rules.estimate(dict(Counter(key)), 9)
    p, plain = np.array([est[k] for k in key]), plain_dawid_skene(votes)
    only = ((votes == 0).sum(1) == 1) & (votes[:, 3] == 0)
    assert only.sum() > 500 and (p[only] >= 0.5).mean() > 0.99
    assert ((p >= 0.5) == (plain >= 0.5)).mean() > 0.995 and np.abs(p - plain).mean() < 0.01


def test_kinds_of_bad_documents():
    """Rules that agree make a bad class, also where several kinds exclude each other."""
    rng, n = np.random.default_rng(4), 4000
    kind = rng.choice(4, n, p=[0.85, 0.05, 0.05, 0.05])
    votes = np.where(rng.random((n, 8)) < 0.01, 0, 2)
    for k, rules in ((1, (0, 1)), (2, (2, 3, 4)), (3, (5, 6))):
        for r in rules:
            votes[(kind == k) & (rng.random(n) < 0.95), r] = 0
    key = (votes * 3 ** np.arange(8)).sum(1).tolist()
    est = quality_rules.estimate(dict(Counter(key)), 8)
    assert np.mean([(est[k] >= 0.5) == (c == 0) for k, c in zip(key, kind, strict=True)]) > 0.985


def test_quality_labels_at_a_larger_size(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    j = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert sum(r.kept == bool(r.quality) for r in j) >= 0.99 * len(j)


def test_vectors_of_a_repeated_id(spark):
    """Each row of an id with several vectors has its own links."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (5, [0.0, -1.0]), (4, [0.01, -1.0]), (4, [0.01, -1.0])]
    got = embedding_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False)]
