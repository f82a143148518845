"""Ingest to a terminal state, graph files, seeds by keys, techniques on one input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweir.operators import catalog, evalkit, seeding
from docweir.sources import graphml, providers
from docweir.streaming import ingest


def test_ingest(spark, tmp_path):
    """A batch that fails in the middle and runs again gives the table of a run without failure."""
    src = tmp_path / "in"
    src.mkdir()
    texts = {f"doc {k}": f"Page one of {k}.\fPage two. " + f"More of {k}. " * (30 * k) for k in range(7)}
    for name, text in texts.items():
        (src / f"{name}.txt").write_text(text)
    (src / "blank.txt").write_text(" \f ")
    (src / "binary.txt").write_bytes(b"\xff\xfe\x00")
    (src / "other.pdf").write_text("not for this pattern")
    calls = []

    def breaks(files):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("parser down")
        return ingest.text_pages(files)

    go = lambda target, parser=ingest.text_pages: ingest.run(spark, str(src), str(tmp_path / target), parser=parser, files_per_batch=3, size=50, overlap=10)
    with pytest.raises(Exception, match="parser down"):
        go("a", breaks)
    half, _ = ingest.tables(spark, str(tmp_path / "a"))
    assert half.count() == 3
    assert {r.error for r in ingest.status(spark, str(src), str(tmp_path / "a")).where("status = 'failed'").collect()} <= {ingest.LATE, ingest.EMPTY}
    states, plain = go("a", breaks), go("b")
    key = lambda df: sorted(map(str, df.drop("batch").collect()))
    assert key(states) == key(plain) and key(go("a")) == key(plain)  # nothing new, nothing twice
    for one, two in zip(ingest.tables(spark, str(tmp_path / "a")), ingest.tables(spark, str(tmp_path / "b")), strict=True):
        assert key(one) == key(two) and one.count()
    assert {r.title: (r.status, r.error) for r in states.collect()} == {t: ("indexed", None) for t in texts} | {"blank": ("failed", ingest.EMPTY), "binary": ("failed", ingest.EMPTY)}
    assert {r.status: r.documents for r in ingest.summary(states).collect()} == {"indexed": 7, "failed": 2}


GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d1" for="edge" attr.name="relation" attr.type="string"/><key id="d0" for="node" attr.name="entity_type" attr.type="string"/>
<graph edgedefault="undirected">{nodes}{edges}</graph></graphml>"""


def test_graph_files(spark, tmp_path):
    node = lambda i, t: f'<node id="{i}"><data key="d0">{t}</data></node>' if t else f'<node id="{i}"/>'
    edge = lambda a, b, r: f'<edge source="{a}" target="{b}"><data key="d1">{r}</data><data key="zz">1</data></edge>'
    graphs = {
        "baseline": ([(f"n{k}", "UNKNOWN") for k in range(26)], [(f"n{k}", f"n{k + 1}", "r") for k in range(12)]),
        "raw": ([(f"n{k}", ["VanBan", "KhaiNiem"][k % 2]) for k in range(52)] + [("odd & <b>", None)], [(f"n{k % 52}", f"n{k * 7 % 60}", "CAN_CU") for k in range(84)]),
        "filtered": ([("a", "VanBan")], []),
    }
    for name, (nodes, edges) in graphs.items():
        esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
        (tmp_path / f"{name}.graphml").write_text(GRAPHML.format(nodes="\n".join(node(esc(i), t) for i, t in nodes), edges="\n".join(edge(esc(a), esc(b), r) for a, b, r in edges)))
    v, e = graphml.read_graphml(spark, str(tmp_path))
    got = {r.graph: (r.nodes, r.edges, r.types, r.isolated, r.dangling) for r in graphml.compared(v, e).collect()}
    for name, (nodes, edges) in graphs.items():
        ids, ends = {i for i, _ in nodes}, {x for a, b, _ in edges for x in (a, b)}
        types = {}
        for _, t in nodes:
            types[t or "UNKNOWN"] = types.get(t or "UNKNOWN", 0) + 1
        assert got[name] == (len(nodes), len(edges), types, len(ids - ends), sum(a not in ids or b not in ids for a, b, _ in edges)), name
    assert e.where("graph = 'raw'").first().properties == {"relation": "CAN_CU", "zz": "1"}
    assert v.where("entity_id = 'odd & <b>'").first().properties == {}


def test_seed_keys(spark):
    """Equal to a plain search for each key, also in groups of keys."""
    names = [("02_TT_09 v1.pdf", "Thông tư 09"), (None, "02_tt_09 again"), ("x", None), (None, None), ("04_qd_215", "QĐ 215"), ("a", "05_QD_342 04_qd_215"), ("abab", "b")]
    t = dt.datetime(2024, 1, 1)
    rows = [(k, f, s, t - dt.timedelta(days=k % 3) if k % 4 else None) for k, (f, s) in enumerate(names * 3)]
    docs = spark.createDataFrame(rows, "id long, filename string, title string, created_at timestamp")
    keys = ["02_tt_09", "04_qd_215", "05_qd_342", "ab", "b", "bab b", " ", "none", "", None, "ab"]
    want = {}
    for k in {k for k in keys if k}:
        hits = [(c is None, c or t, i) for i, f, s, c in rows if k in f"{f or ''} {s or ''}".lower()]
        if hits:
            want[k] = min(hits)[2]
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    for group in (seeding.KEYS, 9):
        assert {r.key: r.id for r in seeding.first_with_key(docs, k, group).collect()} == want
    assert seeding.first_with_key(docs.limit(0), k).count() == 0 and seeding.first_with_key(docs, k.limit(0)).count() == 0


def test_techniques_fail_apart(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, text string")
    t = evalkit.Techniques()
    t.register("advanced", lambda s: s.select("question_id", F.when(F.col("question_id") == 1, F.array("text")).otherwise(F.array().cast("array<string>")).alias("contexts")))
    t.register("raw", lambda s: s.select("question_id", F.array(F.raise_error(F.lit("down")).cast("string")).alias("contexts")))
    t.register("odd", lambda s: s.select("nothing"))
    rows = evalkit.raced(q, t, ["advanced", "raw", "odd"])
    got = {(r.pipeline, r.question_id): (r.answered, r.contexts, r.error is None, r.returned) for r in rows.collect()}
    assert got["advanced", 1] == (True, ["a"], True, 2) and got["advanced", 2] == (False, [], True, 2)
    assert all(got[p, k] == (False, None, False, 0) for p in ("raw", "odd") for k in (1, 2))
    assert {r.pipeline: (r.questions, r.answered, r.failed) for r in evalkit.race_summary(rows).collect()} == {"advanced": (2, 1, 0), "raw": (2, 0, 2), "odd": (2, 0, 2)}
    assert all(r.total_ms >= 0 for r in rows.collect())
    with pytest.raises(ValueError, match="advanced"):
        evalkit.raced(q, t, ["unknown"])


def test_small_ones(spark):
    w = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", None)], "name string, weight double")
    assert [r.name for r in evalkit.positive(w).collect()] == ["b"]
    q = spark.createDataFrame([("  Xin chào,  phí\nthẻ? ",), ("hello",), (None,)], "q string")
    assert [r[0] for r in q.select(providers.rewritten(F.col("q"), providers.ClauseRewriter())).collect()] == ["phí thẻ?", "hello", None]
    assert q.select(providers.rewritten(F.col("q"))).first()[0] == "Xin chào, phí thẻ?"
    with pytest.raises(ValueError, match="pages"):
        catalog.units(w, w, "chapters")
