"""Runs of two pipelines: a stream, a table and a plain list of steps agree."""

import datetime as dt

import numpy as np
import pytest

from docweir.streaming import progress, runs

SCHEMA = "arrival long, run_id long, pipeline string, seq long, kind string, stage string, status string, subgoal_id string, hop long, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event(arrival, run, pipeline, seq, kind="progress", stage="s", status="started", sub="g1", hop=1):
    return arrival, run, pipeline, seq, kind, stage, status, sub, hop, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(arrival))


def drawn(seed, n=400, vague=True):
    rng = np.random.default_rng(seed)
    out, seqs = [], {}
    for k in range(n):
        run, pipe = int(rng.integers(0, 8)), ["advanced", "raw"][rng.integers(0, 2)]
        seq = seqs.get((run, pipe), 0) + int(rng.integers(-1, 3))
        seqs[run, pipe] = max(seq, seqs.get((run, pipe), 0))
        kind = rng.choice(["progress", "token", "done", "error"], p=[0.9, 0.05, 0.03, 0.02])
        sub, hop = (["g1", "g2", None][rng.integers(0, 3 if vague else 2)], [1, 2, None][rng.integers(0, 3 if vague else 2)])
        out.append(event(k, run, pipe, seq, str(kind), f"s{rng.integers(0, 2)}", str(rng.choice(["started", "completed", "failed"])), sub, hop))
    return out


def plain(rows):
    """Changes by walking over all events with whole lists of steps, as a screen holds them."""
    out, steps, ended, span = [], {}, {}, {}
    for a, run, pipe, seq, kind, stage, status, sub, hop, ts in sorted(rows):
        if len(ended.get(run, {})) == 2 or pipe in ended.get(run, {}):
            continue
        held = steps.setdefault((run, pipe), [])
        e = {"seq": seq, "stage": stage if kind == "progress" else f"-{a}", "status": status if kind == "progress" else "started", "subgoal_id": sub, "hop": hop}
        new = progress.upsert(held, e)
        if new is held:
            continue
        first = span.setdefault(run, [ts, ts])
        first[1] = max(first[1], ts)
        gone = {x["seq"] for x in held} - {x["seq"] for x in new}
        if kind in runs.ENDS:
            out.append((run, pipe, seq, runs.ENDS[kind], None, None))
            ended.setdefault(run, {})[pipe] = True
            if len(ended[run]) == 2:
                out.append((run, None, None, "run_done", None, int((first[1] - first[0]).total_seconds() * 1000)))
        else:
            out.append((run, pipe, seq, "replace" if gone else "append", gone.pop() if gone else None, None))
        steps[run, pipe] = new
    return sorted(out, key=str), ended


@pytest.mark.parametrize(("seed", "vague"), [(1, True), (2, False), (3, True)])
def test_table(spark, seed, vague):
    rows = drawn(seed, vague=vague)
    got = runs.changes(spark.createDataFrame(rows, SCHEMA), "arrival").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)[0]


def test_no_events(spark):
    assert runs.changes(spark.createDataFrame([], SCHEMA), "arrival").collect() == []


def test_stream(spark, tmp_path):
    """Three triggers; then a late event moves event time on, and what has not ended expires."""
    rows = drawn(4, 300)
    want, ended = plain(rows)
    alone = [event(100_000, 99, "raw", 1)]
    more = [event(200_000, 100, "raw", 1)]
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = runs.changes_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "arrival")
    try:
        for k, part in enumerate([rows[:100], rows[100:101], rows[101:], alone, more]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(120)  # a query that starts anew each time goes on from its state
            assert q.exception() is None and not q.isActive, k
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    begun = {r[1] for r in rows}
    assert sorted((r for r in got if r[3] != "expired" and r[0] < 99), key=str) == want
    assert {r[0] for r in got if r[3] == "expired"} >= begun - {r for r, e in ended.items() if len(e) == 2}
    last = q.lastProgress["stateOperators"][0]
    assert last["numRowsTotal"] < 20  # ended and expired runs left nothing


def test_error_leaves_the_other(spark):
    rows = [event(1, 1, "raw", 1), event(2, 1, "advanced", 1), event(3, 1, "raw", 2, "error"), event(4, 1, "raw", 3), event(5, 1, "advanced", 2, status="completed"), event(6, 1, "advanced", 3, "done"), event(7, 1, "advanced", 4)]
    got = sorted((tuple(r) for r in runs.changes(spark.createDataFrame(rows, SCHEMA), "arrival").collect()), key=str)
    assert got == sorted([(1, "raw", 1, "append", None, None), (1, "advanced", 1, "append", None, None), (1, "raw", 2, "pipeline_error", None, None), (1, "advanced", 2, "replace", 1, None), (1, "advanced", 3, "pipeline_done", None, None), (1, None, None, "run_done", None, 5000)], key=str)
