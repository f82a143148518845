"""Small cases of single operators."""

import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docweir.functions import text as T
from docweir.operators import catalog, citations, evalkit, graph, lifecycle, vectors
from docweir.operators.durable import components
from docweir.plans.retrieval import coverage, retrieve
from docweir.sources import io
from docweir.sources.providers import ClausePlanner, HashingEmbedder, contextual_prefix
from docweir.streaming import progress


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, "  a   b\n", T.normalize_question) == "a b"
    assert one(spark, "Mật KHẨU Đủ", T.strip_diacritics) == "Mat KHAU Du"
    assert one(spark, "Mật khẩu_1, là!", T.tokens) == ["mật", "khẩu_1", "là"]
    assert one(spark, "Phân loại và cấp độ", T.significant_words) == ["phân", "loại", "cấp", "độ"]
    assert one(spark, "", T.token_count) == 0
    assert one(spark, '```json\n{"a": 1}\n```', T.strip_fence) == '{"a": 1}'
    assert one(spark, '["x", " y "]', T.focus_entities) == ["x", "y"]
    assert one(spark, "a; b,c\n\n", T.focus_entities) == ["a", "b", "c"]
    assert one(spark, "see [1] and [2](x)", T.link_citations) == "see [1](#citation-1) and [2](x)"
    assert one(spark, "multi_hop_abstract", T.hop_type) == "multi-hop"


@pytest.mark.parametrize(("q", "p"), [("Điều \"1\"?\n", "Ann"), ("x", None), (None, None)])
def test_sample_id(spark, q, p):
    got = spark.createDataFrame([(q, p)], "q string, p string").select(T.sample_id(F.col("q"), F.col("p"))).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(T.SAMPLE_NAMESPACE), json.dumps([q, p], ensure_ascii=False)))


def test_fuse(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(1, 3, 10.0), (1, 1, 5.0)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.score) for r in vectors.fuse(d, b, 3).orderBy("rank").collect()] == [(1, 0.75), (3, 0.5), (2, 0.3333)]
    assert vectors.fuse(d.limit(0), b.limit(0), 3).count() == 0


def test_citations(spark):
    rows = [
        (1, "Áp dụng thay cho thời hạn cũ (Quyết định 455/2019/QĐ-DDB)."),
        (2, "Văn bản này thay thế 342/2020/QĐ-DDB, tiếp tục có hiệu lực Phụ lục 02 về phí."),
        (3, "Theo (401/2021/QĐ-DDB) thì ưu tiên áp dụng."),
        (4, "Căn cứ 09/2024/TT-NHNN."),
        (5, "Số 1/2020/NĐ-CP không rõ."),
        (6, None),
    ]
    got = {r.doc_id: r for r in citations.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.type for k, r in got.items()} == {1: "THAM_CHIEU", 2: "THAY_THE", 3: "UU_TIEN_HON", 4: "CAN_CU"}
    assert got[2].partial and got[2].scope == "Phụ lục 02 về phí"


def test_last_type_wins(spark):
    rows = [(1, i, "t", k, False, str(i)) for i, k in enumerate("AABAA", 1)]
    r = citations.last_wins(spark.createDataFrame(rows, "doc_id long, pos int, target string, type string, partial boolean, scope string")).first()
    assert (r.type, r.scope, r.citations) == ("A", "4", 5)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (7, 7)] + [(500, k) for k in range(501, 520)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in (100, 101, 102)}, **{k: 500 for k in range(500, 520)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph(spark):
    v = spark.createDataFrame([("a", "VanBan"), ("v", "GiaTriQuyDinh"), ("k", "KhaiNiem"), ("x", None)], "entity_id string, entity_type string")
    e = spark.createDataFrame([("a", "v", "QUY_DINH"), ("k", "v", "AP_DUNG_CHO"), ("a", "k", "CAN_CU"), ("a", "v", None), ("a", "x", "CAN_CU")], "src string, dst string, relation string")
    assert sorted((r.dst, r.reason) for r in graph.checked(v, e).where("reason is not null").collect()) == [("k", "invalid_triple"), ("v", "unclassified"), ("x", "bad_type")]
    assert one(spark, "phần này thay thế quy định", graph.classify_relation) == "THAY_THE"


def test_lifecycle(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, True, t, None, None, None, t), (2, None, None, None, None, None, t), (3, False, t, t, 9, 2, t)]
    d = spark.createDataFrame(rows, "id long, is_active boolean, effective_date timestamp, expiry_date timestamp, supersedes_id long, superseded_by_id long, created_at timestamp")
    act = spark.createDataFrame([(1, 2, t)], "old long, new long, effective_date timestamp")
    got = {r.id: r for r in lifecycle.supersede(d, act).withColumn("s", lifecycle.lifecycle()).collect()}
    assert (got[1].s, got[1].superseded_by_id, got[1].expiry_date, got[2].is_active, got[2].supersedes_id, got[3].s) == ("superseded", 2, t, True, 1, "superseded")
    assert {(r.id, r.chain) for r in lifecycle.version_chains(d).collect()} == {(1, 1), (2, 2), (3, 2)}
    with pytest.raises(ValueError):
        lifecycle.supersede(d, spark.createDataFrame([(1, 1, t)], "old long, new long, effective_date timestamp"))


def test_catalog(spark):
    rows = [(1, 1, ["Các loại phí", "Phí A"]), (1, 2, ["các loại phí", "Phí B"]), (1, 3, ["Rỗng"]), (1, 4, ["X", "12"]), (1, 5, ["Y", "y", "Z"])]
    got = catalog.pruned(spark.createDataFrame(rows, "doc_id long, ord long, path array<string>"))
    assert sorted((tuple(r.key), r.name) for r in got.collect()) == [(("các loại phí",), "Các loại phí"), (("các loại phí", "phí a"), "Phí A"), (("các loại phí", "phí b"), "Phí B"), (("y",), "Y"), (("y", "z"), "Z")]


def test_evaluation(spark):
    s = spark.createDataFrame([("s", "P1", "m", 0.8), ("s", "P2", "m", 0.6), ("a", "P1", "m", float("nan")), ("a", "P2", "m", 0.4), ("z", None, "m", float("nan"))], "synthesizer string, persona string, metric string, value double")
    assert {(r.name, round(r["mean"], 6)) for r in evalkit.breakdown(s).collect()} == {("s", 0.7), ("a", 0.4), ("P1", 0.8), ("P2", 0.5)}
    w = spark.createDataFrame([("single", 0.5, 0, False), ("abs", 0.25, 0, True), ("spec", 0.25, 0, True)], "name string, weight double, clusters long, multi boolean")
    assert {(r.name, r.weight, r.moved) for r in evalkit.backfill(w).collect()} == {("single", 1.0, 0.0), ("abs", 0.0, 0.25), ("spec", 0.0, 0.25)}
    with pytest.raises(ValueError):
        evalkit.backfill(w.where("name <> 'abs'"))


def test_progress():
    e = lambda seq, status, sub=None, hop=None: {"seq": seq, "stage": "s", "status": status, "subgoal_id": sub, "hop": hop}
    steps = []
    for x in [e(1, "started"), e(2, "completed", "g1", 1), e(2, "completed"), e(1, "started"), e(3, "failed")]:
        steps = progress.upsert(steps, x)
    assert [(x["seq"], x["status"]) for x in steps] == [(2, "completed"), (3, "failed")]


def test_io(spark, tmp_path):
    df = spark.createDataFrame([("q", None, 1)], "b string, a string, c int")
    io.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":"q","c":1}'
    (tmp_path / "s.jsonl").write_text('{"user_input": "q"}\n\n')
    r = io.read_samples(spark, str(tmp_path / "s.jsonl")).first()
    assert r.reference_contexts == [] and r.sample_id
    new = spark.createDataFrame([("q", "n", 5)], "b string, a string, d int")
    assert io.upsert(df, new, ["b"]).collect() == [("q", "n", None, 5)]
    assert io.migrated(df, {"is_active": ("boolean", True)}).first()["is_active"] is True
    assert io.snapshot(df, str(tmp_path / "snap")) == 1 and io.delete_prefix(spark, str(tmp_path / "snap")) and not io.delete_prefix(spark, str(tmp_path / "none"))
    (tmp_path / "blob").mkdir()
    (tmp_path / "blob" / "x.bin").write_bytes(b"\x00\x01")
    assert io.blobs(spark, str(tmp_path / "blob")).first()["content"] == b"\x00\x01"
    assert one(spark, "<p>a<!-- x --> <b>b</b><script>z</script></p>", io.page_text) == "a b"


def test_pages(spark):
    rows = [(1, 2, " b ", None), (1, 1, None, "a"), (2, 1, " ", "")]
    got = {r.document_id: r for r in io.joined_pages(io.parsed_pages(spark.createDataFrame(rows, "document_id long, page_number int, parsed string, text_layer string"))).collect()}
    assert (got[1].text, got[1].status, got[1].n_fallback, got[2].status) == ("a\n\nb", "parsed", 1, "failed")


def test_retrieve(spark):
    docs = spark.createDataFrame([(1, "mật khẩu dài"), (2, "lưu trữ nhật ký"), (3, "điều khác hẳn"), (4, "chương mục nội dung"), (5, "phần chung")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "mật khẩu? lưu trữ?")], "question_id long, text string")
    found, _, goals = retrieve(q, docs, top_k=2)
    assert {r.doc_id for r in found.collect()} >= {1, 2}
    assert coverage(goals).first()["all_satisfied"]
    assert [x.count() for x in retrieve(q.limit(0), docs)] == [0, 0, 0]


def test_providers(spark):
    assert sum(one(spark, "a b a", HashingEmbedder(8).embed)) == 3
    assert one(spark, "x? y", ClausePlanner().plan) == ["x", "y"]
    assert one(spark, "First one. Second.", contextual_prefix) == "First one."


def test_last_wins_finds_citations_once(spark):
    """The citations are no side of a join with themselves; odd keys are left out, rows of a repeated id stay."""
    rows = [(1, 1, "t", "A"), (1, 2, "t", "B"), (1, 3, "t", "B"), (1, 4, "u", "A"), (2, 1, "t", "A"), (2, 1, "t", "A"), (None, 1, "t", "A"), (3, 1, None, "A")]
    c = spark.createDataFrame(rows, "doc_id long, pos int, target string, type string").selectExpr("*", "false as partial", "cast(null as string) as scope")
    got = citations.last_wins(c)
    assert sorted((r.doc_id, r.target, r.type, r.pos, r.citations) for r in got.collect()) == [(1, "t", "B", 2, 3), (1, "u", "A", 4, 1), (2, "t", "A", 1, 2), (2, "t", "A", 1, 2)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
