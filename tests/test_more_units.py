"""Readers with their errors, resolution as a whole, scopes, search on odd vectors and in another order."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweir.functions import text as T
from docweir.operators import catalog, durable, evalkit, graph, graphsearch, lifecycle, resolution, vectors
from docweir.plans.tables import table
from docweir.registry import ORACLES, QUERIES
from docweir.sources import io
from tests.conftest import SF


def test_readers(spark, tmp_path):
    p = tmp_path / "personas.json"
    with pytest.raises(ValueError, match="no personas"):
        io.read_personas(spark, str(p))
    for bad, said in (("{}", "list"), ("[]", "list"), ('[{"name": "a", "role_description": "b"}, {"name": "c"}]', "persona 1")):
        p.write_text(bad)
        with pytest.raises(ValueError, match=said):
            io.read_personas(spark, str(p))
    p.write_text('[{"name": "a", "role_description": "b"}]')
    assert io.read_personas(spark, str(p)).collect() == [("a", "b")]
    c = tmp_path / "contract.json"
    c.write_text(json.dumps({"version": "1", "entities": [{"id": "e", "name": "E", "type": "t", "chunk_ids": ["1", "2"]}], "relations": [{"source": "e", "target": "x", "type": "r"}]}, indent=1))
    entities, relations = io.read_contract(spark, str(c))
    assert [(r.ord, r.id, r.chunk_ids) for r in entities.collect()] == [(0, "e", ["1", "2"])] and relations.collect() == [("e", "x", "r")]
    assert [r.error for r in evalkit.contract_errors(entities, relations).collect()] == ["dangling target"]
    types, words, triples = io.read_ontology(spark, "entity_types: {A: {description: x}, B: }\nrelation_types: {R: {keywords: [k, l]}}\nallowed_triples: [[A, R, B]]")
    assert types.count() == 2 and words.count() == 2 and sorted(map(tuple, triples.collect())) == [("A", "R", "B"), ("B", "R", "A")]
    j = tmp_path / "s.jsonl"
    j.write_text('{"user_input": "q"}\n')
    assert io.load_dataset(spark, str(j), {}).count() == 1 and io.load_dataset(spark, "labels", {"labels": f"{SF}/labels.parquet"}).count() > 0
    with pytest.raises(ValueError, match="known: labels"):
        io.load_dataset(spark, "none.jsonl", {"labels": "x"})


def test_lenient_json(spark):
    rows = spark.createDataFrame([('x {"a": 1} y',), ("none",), (None,)], "x string").select(T.lenient_json(F.col("x")).cast("string").alias("j"), T.lenient_json(F.col("x"), None).cast("string").alias("n")).collect()
    assert [(r.j, r.n) for r in rows] == [('{"a":1}', '{"a":1}'), ("{}", None), ("{}", None)]


def test_resolved(spark):
    v = spark.createDataFrame([("vb1", "VanBan", "long text", 1), ("vb2", "VanBan", "x", 1), ("Mật khẩu", "KhaiNiem", "ab", None), ("mat khau", "KhaiNiem", "abc", None), ("g", "GiaTriQuyDinh", None, None)], "entity_id string, entity_type string, description string, number int")
    e = spark.createDataFrame([("vb2", "g", "QUY_DINH"), ("g", "Mật khẩu", "AP_DUNG_CHO"), ("vb1", "vb2", "CAN_CU")], "src string, dst string, relation string")
    vertices, edges = resolution.resolved(v, e)
    assert {r.entity_id for r in vertices.collect()} == {"g", "mat khau", "vb2"} or {r.entity_id for r in vertices.collect()} == {"g", "mat khau", "vb1"}
    assert {(r.dst, r.relation) for r in edges.collect()} == {("g", "QUY_DINH"), ("mat khau", "AP_DUNG_CHO")}
    kept = [r for r in vertices.collect() if r.entity_id == "mat khau"][0]
    assert kept.description == "abc <MERGED_FROM> ab" and resolution.merged_vertices(v, v.limit(0).selectExpr("entity_id as old", "entity_id as new")).count() == 5


def test_fuzzy_mapping_does_not_depend_on_order(spark):
    v = spark.createDataFrame([(n, "x" * k) for k, n in enumerate("abcdef")], "entity_id string, description string")
    pairs = [("a", "b"), ("b", "c"), ("e", "d")]
    for some in (pairs, pairs[::-1]):
        got = sorted(map(tuple, resolution.fuzzy_mapping(v, spark.createDataFrame(some, "a string, b string")).collect()))
        assert got == [("a", "c"), ("b", "c"), ("d", "e")]


def test_citation_targets(spark):
    v = spark.createDataFrame([("Law 1/2020/X", "VanBan", "t1"), ("Law 2/2020/X", "VanBan", "t2")], "entity_id string, entity_type string, file_path string")
    c = spark.createDataFrame([("t1", "2/2020/X", "CAN_CU"), ("t1", "1/2020/X", "CAN_CU"), ("t1", "9/2020/X", "THAY_THE"), ("t3", "2/2020/X", "CAN_CU")], "title string, target string, type string")
    edges, new = resolution.citation_targets(c, v)
    assert sorted((r.src, r.dst, r.relation) for r in edges.collect()) == [("Law 1/2020/X", "9/2020/X", "THAY_THE"), ("Law 1/2020/X", "Law 2/2020/X", "CAN_CU")]
    assert [r.entity_id for r in new.collect()] == ["9/2020/X"]


def test_facts_are_starved_by_citations(spark):
    row = lambda q, f: (q, f)
    cite = spark.createDataFrame([row(1, f"c{k}") for k in range(6)] + [row(2, "c0")], "query_id long, fact_id string")
    concept = spark.createDataFrame([row(1, "k"), row(2, "c0"), row(2, "k")], "query_id long, fact_id string")
    got = graphsearch.first_facts([cite, concept], 6).collect()
    assert sorted(r.fact_id for r in got if r.query_id == 1) == [f"c{k}" for k in range(6)] and sorted(r.fact_id for r in got if r.query_id == 2) == ["c0", "k"]


def test_search_of_odd_vectors_either_way(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4 + k % 2).round(3).tolist()) for k in range(200)] + [(500, None), (501, [0.0] * 4), (502, [float("nan")] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0 or vec_id > 499").select(F.col("vec_id").alias("query_id"), "embedding")
    one = {(r.query_id, r.vec_id, round(r.score, 9), r.rank) for r in vectors.search(v, q, 5).collect()}
    two = {(r.query_id, r.vec_id, round(r.score, 9), r.rank) for r in vectors.search(v.repartition(7), q.repartition(5).orderBy(F.desc("query_id")), 5, broadcast=0).collect()}
    assert one == two and len({x[0] for x in one}) == 11 and not any(x[1] in (500, 502) for x in one)


def test_scope(spark, tmp_path):
    with durable.scope(spark):
        t = durable.durable(spark.range(3).toDF("id"), "x")
        path = t._docweir_path
        assert t.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()


def test_lifecycle_and_evaluation(spark):
    docs = spark.createDataFrame([(1, "indexed", "done"), (2, "indexed", "building"), (3, "parsing", None)], "document_id long, status string, graph_status string")
    chunks = spark.createDataFrame([(1, 0), (2, 0), (None, 0)], "document_id long, chunk_index int")
    d, left = lifecycle.reset(docs, {"chunks": chunks}, docs)
    assert {(r.document_id, r.status) for r in d.collect()} == {(1, "uploaded"), (2, "indexed"), (3, "uploaded")} and left["chunks"].count() == 2
    assert [r.graph_status for r in lifecycle.recovered(docs).orderBy("document_id").collect()] == ["done", "failed", None]
    assert evalkit.collected(chunks, docs, [1]).count() == 1
    with pytest.raises(ValueError, match=r"not found: \[9\]; not indexed: \[3\]"):
        evalkit.collected(chunks, docs, [1, 3, 9])
    t = evalkit.Techniques()
    t.register("echo", lambda s: s.select("question_id", F.array("text").alias("contexts")))
    samples = spark.createDataFrame([(1, "a")], "question_id long, text string")
    assert evalkit.ran(samples, t, ["echo", "echo"]).count() == 2
    with pytest.raises(ValueError, match="known: echo"):
        evalkit.ran(samples, t, ["none"])


def test_catalog_fallback(spark):
    units = spark.createDataFrame([(1, 0, " "), (1, 1, "a"), (2, 0, None)], "doc_id long, unit long, text string")
    whole = spark.createDataFrame([(1, "no"), (2, "b")], "doc_id long, text string")
    answer = lambda t: F.concat(F.lit('{"facets": [{"entity": "Top", "headings": ["'), t, F.lit('", ""]}]}'))
    got = catalog.generated(units, answer, whole)
    assert sorted((r.doc_id, tuple(r.key)) for r in got.collect()) == [(1, ("top",)), (1, ("top", "a")), (2, ("top",)), (2, ("top", "b"))]


def test_no_nested_loops(spark):
    """Derived tables and what stands on them join by equality."""
    for name in ("edges", "vertices", "versions", "citing", "paths"):
        assert "NestedLoop" not in table(spark, SF, name)._jdf.queryExecution().toString(), name
    for name in ("graph_stats", "node_merge_edges", "citation_neighbors_h2", "graph_facts", "parallel_edge_dedupe", "contains_lookup"):
        assert "NestedLoop" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString(), name
    assert set(ORACLES) <= set(QUERIES) and graph.TRIPLES


def test_version_chains_with_cycles(spark):
    """Cycles, ids that don't exist, links that only one side has, and a fork."""
    from docweir.operators import lifecycle

    rows = [(1, 2, None), (2, 3, None), (3, 1, None), (10, 99, None), (11, 10, 98), (20, None, 21), (21, None, None), (30, 30, None), (40, 41, None), (42, 41, None), (41, None, None)]
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=-k)
    d = spark.createDataFrame([(i, s, b, None, day(i)) for i, s, b in rows], "id long, supersedes_id long, superseded_by_id long, effective_date timestamp, created_at timestamp")
    got = {r.id: (r.chain, r.version) for r in lifecycle.version_chains(d).collect()}
    assert got == {3: (1, 1), 2: (1, 2), 1: (1, 3), 11: (10, 1), 10: (10, 2), 21: (20, 1), 20: (20, 2), 30: (30, 1), 42: (40, 1), 41: (40, 2), 40: (40, 3)}
