"""Repeated strings against a dictionary of all of them."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from docweir.llm import suffix_dedup
from tests.conftest import SF


def plain(texts, span):
    """For each text, which bytes a string of span bytes covers that starts anywhere else."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append(gone)
    return out


def expected(rows, span):
    out = []
    for (key, text), gone in zip(rows, plain([t for _, t in rows], span), strict=True):
        raw = (text or "").encode()
        ranges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((key, len(raw), int(gone.sum()), len(ranges), tuple(map(tuple, ranges.tolist())), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def reported(df, span):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, tuple(tuple(x) for x in r.removed), r.kept_sha256) for r in suffix_dedup.span_report(df, span).collect()), key=str)


def edited(rng, text):
    for _ in range(rng.integers(0, 4)):
        at = rng.integers(0, len(text) + 1)
        text = text[:at] + "é"[: rng.integers(0, 2)] + text[at + rng.integers(0, 3) :]
    return text


def drawn(rng, n, letters):
    """Texts that share passages of one another, edited, of few letters, periodic in part."""
    out = []
    for k in range(n):
        parts = []
        for _ in range(rng.integers(0, 6)):
            kind = rng.integers(0, 4)
            if kind == 0 and out:
                old = out[rng.integers(0, len(out))][1] or ""
                a = rng.integers(0, len(old) + 1)
                parts.append(edited(rng, old[a : a + rng.integers(0, 300)]))
            elif kind == 1:
                parts.append("".join(rng.choice(list(letters), rng.integers(1, 4))) * rng.integers(1, 40))
            else:
                parts.append("".join(rng.choice(list(letters), rng.integers(0, 120))))
        out.append((k, "".join(parts)))
    return out


@pytest.mark.parametrize(("span", "letters", "seed"), [(20, "ab", 1), (20, "abcdefgh ", 2), (200, "abcdefghij \n", 3), (7, "xyé日", 4), (60, "ab\n", 5), (2, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 6)])
def test_against_plain(spark, span, letters, seed):
    rows = drawn(np.random.default_rng(seed), 120, letters)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert reported(df, span) == expected(rows, span)


def test_many_partitions(spark):
    """Buckets that partitions cut through; one hot passage."""
    rng = np.random.default_rng(8)
    hot = "".join(rng.choice(list("abcdef "), 90))
    rows = [(k, f"{k} " * (k % 5) + hot[k % 7 :] + f" {k * k}" * (k % 9)) for k in range(150)] + [(1000 + k, hot) for k in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = reported(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 30)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == expected(rows, 30)


def test_long_texts_are_cut_into_segments(monkeypatch):
    from docweir.llm.textvec import Texts

    raw = np.frombuffer(("abcab" * 300 + "xyz" + "q" * 500).encode(), np.uint8)
    windows = lambda: sorted((int(p - b), int(p)) for doc, p, b1, b2, _, _ in suffix_dedup.anchors(Texts(raw, np.array([0, len(raw)])), 40) for p, x, y in zip(p, b1, b2, strict=True) for b in range(x, y + 1))
    whole = windows()
    assert [s for s, _ in whole] == list(range(len(raw) - 39))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    assert windows() == whole


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert reported(odd, 200) == expected(rows, 200)
    cut = suffix_dedup.without_repeated_spans(odd, 200)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    got = {r.doc_id: r for r in cut.collect()}
    assert got[3].text is None and got[4].text == "" and got[2].text == "" and got[2].n_chars == 0
    assert got[8].text == " more" or got[8].text.endswith(" more")
    assert suffix_dedup.span_report(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="span"):
        suffix_dedup.repeated(odd, 1)


def test_half_a_character(spark):
    """A repeated string may end inside a character."""
    shared = "z" * 29 + "é"
    rows = [(1, f"one {shared} end"), (2, f"two {'z' * 29}è fin")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert reported(df, 30) == expected(rows, 30)
    assert all("�" in r.text or "z" not in r.text for r in suffix_dedup.without_repeated_spans(df, 30).collect())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.op11_suffix_dedup(spark, SF).collect()), key=str)
    assert got == [(a, b, c, d, f) for a, b, c, d, _, f in expected(rows, 200)]
    assert suffix_dedup.op11_suffix_dedup(spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
