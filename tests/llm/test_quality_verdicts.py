"""What a rule is worth that no other confirms."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweir.llm import quality_rules
from tests.conftest import SF


def estimated(votes):
    n = votes.shape[1]
    key = (votes * 3 ** np.arange(n)).sum(1).tolist()
    est = quality_rules.estimate(dict(Counter(key)), n)
    return np.array([est[k] for k in key])


def test_kinds_that_one_rule_sees():
    votes = np.full((2300, 11), 2)
    votes[2000:, :] = 2
    for k, r in enumerate((2, 0, 7)):
        votes[2000 + 100 * k : 2100 + 100 * k, r] = 0
    p = estimated(votes)
    assert (p[:2000] > 0.5).all() and (p[2000:] < 0.5).all()


@pytest.mark.parametrize(("share", "kept"), [(0.01, False), (0.2, False), (0.45, True)])
def test_many_alarms_are_noise(share, kept):
    """A rule that calls nearly half of all bad, with nobody to agree, is no reason to drop them."""
    rng = np.random.default_rng(2)
    votes = np.where(rng.random((5000, 6)) < 0.1, 1, 2)
    votes[rng.random(5000) < share, 4] = 0
    p = estimated(votes)
    assert (p[votes[:, 4] != 0] > 0.5).all()
    assert ((p[votes[:, 4] == 0] > 0.5) == kept).all()


def test_capitals(spark):
    """Good documents put in capitals, which just one rule sees, in place of themselves."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = quality_rules.judge(docs).where("kept").join(labels.where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(40).select("doc_id", F.lit(True).alias("loud"))
    mixed = docs.join(good, "doc_id", "left").withColumn("text", F.when(F.col("loud"), F.upper("text")).otherwise(F.col("text"))).drop("loud")
    j = quality_rules.judge(mixed).select("doc_id", "kept")
    assert j.join(good, "doc_id").where("kept").count() == 0
    rest = j.join(good, "doc_id", "left_anti").join(labels, "doc_id").where("quality = 1")
    assert rest.where("not kept").join(quality_rules.judge(docs).where("kept"), "doc_id").count() == 0


@pytest.mark.parametrize("without", [("letters",), ("letters", "bars"), ("symbols",), ("variety", "bars")])
def test_labels_don_t_hang_on_doubled_rules(spark, without):
    """Left out rules change no verdict while one that sees the kind is left."""
    names = list(quality_rules.rules())
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs).join(labels, "doc_id", "left").select("pattern", "base_failed", "quality").collect()
    votes = np.array([[r.pattern // 3**i % 3 for i, n in enumerate(names) if n not in without] for r in rows])
    p = estimated(votes)
    known = [(x >= 0.5, bool(r.quality)) for x, r in zip(p, rows, strict=True) if not r.base_failed and r.quality is not None]
    assert sum(a == b for a, b in known) >= 0.99 * len(known)
