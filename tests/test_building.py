"""Building by parts equals building at once; steps fail alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweir.operators import building, durable


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_parts(spark, seed):
    rng = np.random.default_rng(seed)
    frame = lambda e: spark.createDataFrame([(int(a), int(b)) for a, b in e], "a long, b long")
    every = [tuple(x) for x in rng.integers(0, 400, (260, 2))]
    labels = durable.components(frame(every[:130]))
    for part in (every[130:200], every[200:], [(5, 5)]):
        labels = building.joined(labels, frame(part))
    got = {r.id: r.component for r in labels.collect()}
    assert got == plain(every)
    gone, left = every[::7], [e for k, e in enumerate(every) if k % 7]
    gone = [e for e in gone if e not in left and e[::-1] not in left]
    now = building.parted(labels, frame(gone), frame(left))
    assert {r.id: r.component for r in now.collect()} == plain(left)


def test_halves_equal_the_whole(spark):
    v = [(f"d{k}", "VanBan", "x" * (k % 5), k % 4) for k in range(12)] + [(n, "KhaiNiem", n, None) for n in ("phí thẻ", "phi the", "PHÍ THẺ", "lãi")]
    e = [(f"d{k}", f"d{(k * 5 + 1) % 12}", "CAN_CU", False, None) for k in range(12)] + [("d1", "phi the", "QUY_DINH", False, None), ("d2", "PHÍ THẺ", "QUY_DINH", False, None)]
    frame = lambda vs, es: (spark.createDataFrame(vs, "entity_id string, entity_type string, description string, number int"), spark.createDataFrame(es, "src string, dst string, relation string, partial boolean, scope string"))
    whole_v, whole_e, log = building.built(*frame(v, e))
    assert [r.status for r in log.orderBy("ord").collect()] == ["done"] * 3
    half_v, half_e, _ = building.built(*frame(v[:6] + v[12:14], e[:3]))
    rest_v, rest_e = frame(v[6:12] + v[14:], e[3:])
    rest_e = building.renamed(rest_e, half_v).select(half_e.columns)
    again_v, again_e, _ = building.built(half_v.unionByName(rest_v, allowMissingColumns=True).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), half_e.unionByName(rest_e))

    def shape(v, e):
        """Vertices as sets of all their names, edges between those sets."""
        group = {n: frozenset([r.entity_id, *r.aliases]) for r in v.collect() for n in [r.entity_id, *r.aliases]}
        return set(group.values()), {(group[r.src], group[r.dst], r.relation) for r in e.collect()}

    assert shape(again_v, again_e) == shape(whole_v, whole_e)
    assert whole_v.count() == 6


def test_steps_fail_apart(spark):
    v = spark.createDataFrame([("a", "VanBan", "x", 1), ("b", "VanBan", "y", 1)], "entity_id string, entity_type string, description string, number int")
    e = spark.createDataFrame([("a", "b", "CAN_CU", False, None)], "src string, dst string, relation string, partial boolean, scope string")
    steps = [("good", lambda v, e: (v.where("entity_id = 'a'"), e)), ("late", lambda v, e: (v.withColumn("description", F.raise_error(F.lit("down")).cast("string")), e)), ("typo", lambda v, e: (v.select("nothing"), e)), ("last", lambda v, e: (v, e.limit(0)))]
    out_v, out_e, log = building.built(v, e, steps)
    assert [(r.step, r.status, r.vertices, r.edges) for r in log.orderBy("ord").collect()] == [("good", "done", 1, 1), ("late", "failed", 1, 1), ("typo", "failed", 1, 1), ("last", "done", 1, 0)]
    assert "down" in log.where("step = 'late'").first().error and out_v.first().description == "x" and out_e.isEmpty()
    with pytest.raises(Exception, match="down"):
        building.built(v, e, steps, required=2)
