"""The retrieval loop: what the second hop is for, channels, switches and judges."""

import pytest
from pyspark.sql import functions as F

from docweir.operators import prompts
from docweir.plans import retrieval


@pytest.fixture(scope="module")
def sources(spark):
    docs = [(1, "tỷ lệ an toàn vốn tối thiểu", "thông tư a", True), (2, "hạn mức mới", "thông tư b", True), (3, "phí thường niên của thẻ", "biểu phí", None), (4, "tỷ lệ an toàn cũ", "thông tư c", False), (5, "chuyện khác", "khác", True), (6, "nội dung nữa", "nữa", True)]
    d = spark.createDataFrame(docs, "doc_id long, text string, title string, is_active boolean")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [1.0, 0.1])], "doc_id long, embedding array<float>")
    vertices = spark.createDataFrame([(t, "VanBan", t) for t in ("thông tư a", "thông tư b", "thông tư c", "biểu phí")] + [("500 nghìn", "GiaTriQuyDinh", None), ("phí thẻ", "KhaiNiem", None)], "entity_id string, entity_type string, file_path string")
    edges = spark.createDataFrame([("thông tư b", "thông tư a", "THAY_THE"), ("500 nghìn", "phí thẻ", "AP_DUNG_CHO"), ("biểu phí", "500 nghìn", "QUY_DINH")], "src string, dst string, relation string")
    concepts = spark.createDataFrame([("phí thẻ", None)], "name string, embedding array<float>")
    outlines = spark.createDataFrame([(1, "# A"), (3, "# P"), (4, "# old")], "doc_id long, outline string")
    return retrieval.Sources(d, v, vertices, edges, concepts, outlines)


def questions(spark, rows):
    return spark.createDataFrame(rows, "question_id long, text string, embedding array<float>, hybrid boolean, graph boolean")


def test_second_hop_finds_what_a_fact_names(spark, sources):
    q = questions(spark, [(1, "an toàn vốn", None, True, True), (2, "an toàn vốn", None, True, False), (3, "không có gì như vậy xyz", None, True, True)])
    found, facts, goals = retrieval.retrieve(q, sources, top_k=2)
    by = {r.question_id: r for r in goals.collect()}
    assert (by[1].satisfied, by[1].hops, by[1].note) == (True, 2, "")  # thông tư b replaces a, and comes at the second hop
    assert (by[2].satisfied, by[2].hops) == (True, 1)
    assert (by[3].satisfied, by[3].hops, by[3].note) == (False, 3, retrieval.WEAK) or by[3].satisfied
    assert {r.doc_id for r in found.where("question_id = 1").collect()} >= {1, 2}
    assert 4 not in {r.doc_id for r in found.collect()}  # inactive
    assert [r.fact_id for r in facts.where("question_id = 1").collect()] == ["thông tư b|THAY_THE|thông tư a"]
    assert facts.where("question_id = 2").isEmpty()
    assert {r.question_id: r.all_satisfied for r in retrieval.coverage(goals).collect()}[1]


def test_concepts_are_the_other_strategy(spark, sources):
    _, facts, _ = retrieval.retrieve(questions(spark, [(1, "phí thẻ", None, True, True)]), sources, hops=1)
    assert {r.fact_id for r in facts.where("relation <> 'THAY_THE'").collect()} == {"500 nghìn|AP_DUNG_CHO|phí thẻ", "biểu phí|QUY_DINH|500 nghìn"}


def test_switch_between_searches(spark, sources):
    q = questions(spark, [(1, "hạn mức", [1.0, 0.0], False, False), (2, "hạn mức", [1.0, 0.0], True, False)])
    found, _, _ = retrieval.retrieve(q, sources, top_k=2, hops=1)
    rows = {k: [(r.doc_id, round(r.score, 3)) for r in found.where(f"question_id = {k}").orderBy("rank").collect()] for k in (1, 2)}
    assert rows[1] == [(1, 1.0), (3, 0.6)]  # cosines, as they are
    assert {d for d, _ in rows[2]} == {1, 2}  # half of each


def test_a_judge_is_joined_by_id(spark, sources):
    def judge(goals, evidence, facts):
        said = goals.where("question_id = 1").select(F.col("query_id").alias("goal_id"), F.lit(False).alias("satisfied"), F.lit(" thông tư b ").alias("note"))
        return said

    q = questions(spark, [(1, "an toàn vốn", None, True, False), (2, "an toàn vốn", None, True, False), (3, "qqq", None, True, False)])
    found, _, goals = retrieval.retrieve(q, sources, hops=2, judge=judge)
    by = {r.question_id: (r.satisfied, r.note, r.hops) for r in goals.collect()}
    assert by == {1: (False, "thông tư b", 2), 2: (True, "", 1), 3: (False, prompts.NO_EVIDENCE, 2)}  # left out: by whether there is any
    assert 2 in {r.doc_id for r in found.where("question_id = 1").collect()}  # searched with the note


def test_outlines(spark, sources):
    live = retrieval.Sources(sources.docs.where("coalesce(is_active, true)"), sources.vectors, outlines=sources.outlines)
    got = retrieval.outlines(questions(spark, [(1, "x", [1.0, 0.0], True, True), (2, "y", None, True, True)]), live, 3)
    assert [tuple(r) for r in got.collect()] == [(1, "# A\n\n# P")]


def test_no_graph_no_vectors(spark, sources):
    found, facts, goals = retrieval.retrieve(spark.createDataFrame([(1, "hạn mức; phí"), (2, None)], "question_id long, text string"), retrieval.Sources(sources.docs))
    assert facts.isEmpty() and {r.subgoal for r in goals.where("question_id = 1").collect()} == {"g1", "g2"}
    assert {2, 3} <= {r.doc_id for r in found.collect()}


def test_vectors_are_searched_once(spark, sources, monkeypatch):
    """A goal's later hops change its text alone: one search of vectors for the passages of all hops."""
    calls, plain = [], retrieval.vectors.search

    def search(*a, **b):
        calls.append(b.get("vec_id"))
        return plain(*a, **b)

    monkeypatch.setattr(retrieval.vectors, "search", search)
    q = questions(spark, [(1, "an toàn vốn", [1.0, 0.0], True, True), (3, "không có gì như vậy xyz", None, True, True)])
    _, _, goals = retrieval.retrieve(q, sources, top_k=2)
    assert max(r.hops for r in goals.collect()) > 1 and calls.count("doc_id") == 1
