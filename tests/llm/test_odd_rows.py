"""Each operator and stage on odd rows, and on none."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docweir.llm import bpe, embedding_join, jaccard_join, language_id, license_scan, line_dedup, mixing, perplexity, quality_rules, token_packing


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (7, 1, 0), (None, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")


REPORTS = {
    "line_dedup": line_dedup.line_report,
    "language_id": language_id.identify,
    "byte_bpe": bpe.token_digests,
    "ngram_jaccard": jaccard_join.join,
    "mixing": mixing.mix_report,
    "perplexity": lambda d: perplexity.classify(d, labels(d.sparkSession)),
    "quality_rules": quality_rules.judge,
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_a_row_each(odd, name):
    got = REPORTS[name](odd).collect()
    ids = sorted([r.doc_id for r in got], key=str)
    assert ids == sorted([r.doc_id for r in odd.select("doc_id").collect()], key=str)
    assert REPORTS[name](odd.limit(0)).count() == 0


def test_lines(odd):
    got = {r.doc_id: r for r in line_dedup.line_report(odd).collect()}
    assert got[3].n_lines == 1 and got[3].n_removed == 0
    assert got[2].n_removed == 1 and got[1].n_removed == 0
    assert got[8].n_removed >= 490
    cut = {r.doc_id: r for r in line_dedup.without_repeats(odd).collect()}
    assert cut[2].text == "" and cut[1].text and cut[3].text is None and cut[8].text.endswith(" more") and cut[8].n_chars == len(cut[8].text)
    assert cut[8].prefix == "p"


def test_language(odd):
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[11].lang_pred == "und" and got[3].score == 0
    assert got[1].held_out == (__import__("zlib").crc32(b"1") % 4 == 2)


def test_bpe(odd):
    got = {r.doc_id: r for r in bpe.token_digests(odd).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[3].n_tokens, got[3].ids_sha256, got[4].decoded_sha256) == (0, empty, empty)
    assert got[10].decoded_sha256 == hashlib.sha256("日本 語の テキスト é\x00ü".encode()).hexdigest()
    ids = bpe.encoded(odd.where("doc_id in (1, 3, 10)"))
    assert {r.doc_id: r.text for r in bpe.decoded(ids).collect()} == {r.doc_id: r.text or "" for r in odd.where("doc_id in (1, 3, 10)").collect()}


def test_licenses(odd):
    assert license_scan.find(odd).count() == 0 and license_scan.find(odd.limit(0)).count() == 0


def test_jaccard(odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd).collect()]
    by = {d: (n, c) for d, n, c in got if d is not None}
    assert by[1] == by[2] and by[1][1] == 1 and by[8][1] == 7 and by[3] == (0, 3) and by[6] == (1, 6)
    assert [c for d, _, c in got if d is None] == [None, None]


def test_mixing(odd):
    got = mixing.mix_report(odd).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.doc_id: r.taken for r in got}[3] == 0


def test_packing(odd, spark):
    got = token_packing.packed_texts(odd, length=64).collect()
    assert all(r.n_tokens <= 64 and r.cu_seqlens[-1] == r.n_tokens for r in got)
    assert 3 not in {d for r in got for d in r.doc_ids} and None in {d for r in got for d in r.doc_ids}
    assert token_packing.packed_texts(odd.limit(0)).count() == 0


def test_quality(odd):
    got = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert got[3].base_failed and not got[3].kept and got[3].n_words == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.judge(odd).where("kept").collect()}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], None), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [0.0, -1.0], 1), (3, [1.0, 0.0], 3)]
    v = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, key string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.join(v).collect() if r.vec_id is not None)
    assert got[:4] == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False)]
    assert all(n == 0 and c == i and k for i, n, c, k in got[4:])
    assert embedding_join.join(v.limit(0)).count() == 0 and embedding_join.join(v.where("vec_id in (4, 5)")).count() == 2


def test_vectors_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0, 0.0]), (7, [3.0]), (8, [0.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in embedding_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == [(1, 2, 1, True), (2, 1, 2, True), (3, 2, 1, False), (4, 1, 2, False), (5, 2, 1, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]


def test_pipeline(odd, spark):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0, name
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
        out.collect()
