"""Runs of several pipelines at once, as one stream of events that ends when all of them have ended.

Events: run_id (long), pipeline, seq (long), kind (`progress`, `done` or `error`; others pass as they are), and for
progress stage, status, subgoal_id and hop (long). `done` and `error` end their pipeline and leave the others.

- An event whose seq is not above all before it in its pipeline is dropped, and so is one that comes after its
  pipeline's end.
- A progress event other than `started` takes the place of the latest open `started` event of its stage, with
  the same sub-goal and hop, or else one where these don't contradict. Without one it is added.

What comes out are changes to the list of steps, so that nothing has to be held but steps that are still open:
run_id, pipeline, seq, action (`append`, `replace`, `pipeline_done`, `pipeline_error`, `run_done`, `expired`), replaces (the seq
whose place it takes) and total_ms (at the end of a run, since its first event).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "run_id long, pipeline string, seq long, action string, replaces long, total_ms long"
ENDS = {"done": "pipeline_done", "error": "pipeline_error"}
_FIELDS = ["run_id", "pipeline", "seq", "kind", "stage", "status", "subgoal_id", "hop", "ts"]


def closes(open_steps: dict[int, tuple], stage: str, subgoal_id: str | None, hop: int | None) -> int | None:
    """The seq of the open step (seq -> stage, subgoal_id, hop) that an event of the stage closes, if any."""
    for loose in (False, True):
        for seq in sorted(open_steps, reverse=True):
            s, g, h = open_steps[seq]
            if s == stage and all(a == b or loose and (a is None or b is None) for a, b in ((g, subgoal_id), (h, hop))):
                return seq
    return None


class _Run(StatefulProcessor):
    """State of a run: when it began and its timer, of each pipeline the last seq and whether it ended, and
    the open steps. All of it goes when the last pipeline ends, or when nothing came for idle_ms."""

    def __init__(self, pipelines: int, idle_ms: int):
        self.pipelines, self.idle_ms = pipelines, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long, timer long")
        self.seqs = handle.getMapState("pipelines", "pipeline string", "seq long, ended boolean")
        self.open = handle.getMapState("open", "pipeline string, seq long", "stage string, subgoal_id string, hop long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows)
        events = events.sort_values("arrival", kind="stable")
        at = (events["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        cols = [events[c].astype(object).where(events[c].notna(), None).tolist() for c in ("pipeline", "seq", "kind", "stage", "status", "subgoal_id", "hop")]
        first, last, timer = self.run.get() if self.run.exists() else (None, None, None)
        seqs = {k[0]: tuple(v) for k, v in self.seqs.iterator()}
        before = {tuple(k): tuple(v) for k, v in self.open.iterator()}
        steps: dict[str, dict[int, tuple]] = {}
        for (p, s), v in before.items():
            steps.setdefault(p, {})[s] = v
        out, finished = [], False
        for t, pipeline, seq, kind, stage, status, subgoal, hop in zip(at, *cols, strict=True):
            most, ended = seqs.get(pipeline, (None, False))
            if finished or ended or seq is None or (most is not None and seq <= most):
                continue
            first, last = (t, t) if first is None else (min(first, t), max(last, t))
            seqs[pipeline] = (int(seq), kind in ENDS)
            mine = steps.setdefault(pipeline, {})
            if kind in ENDS:
                out.append((pipeline, seq, ENDS[kind], None, None))
                mine.clear()
                if sum(e for _, e in seqs.values()) >= self.pipelines:
                    out.append((None, None, "run_done", None, last - first))
                    finished = True
            elif kind == "progress" and status != "started":
                closed = closes(mine, stage, subgoal, hop)
                mine.pop(closed, None)
                out.append((pipeline, seq, "append" if closed is None else "replace", closed, None))
            else:
                out.append((pipeline, seq, "append", None, None))
                if kind == "progress":
                    mine[int(seq)] = (stage, subgoal, None if hop is None else int(hop))
        if timer is not None:
            self.handle.deleteTimer(timer)
        if finished:
            self._clear()
        elif first is not None:
            timer = max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
            self.run.update((first, last, timer))
            for p, v in seqs.items():
                self.seqs.updateValue((p,), v)
            now = {(p, s): v for p, own in steps.items() for s, v in own.items()}
            for k in before.keys() - now.keys():
                self.open.removeKey(k)
            for k in now.keys() - before.keys():
                self.open.updateValue(k, now[k])
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, _ = self.run.get()
        self._clear()
        yield self._frame(key, [(None, None, "expired", None, last - first)])

    def _clear(self) -> None:
        self.run.clear()
        self.seqs.clear()
        self.open.clear()

    @staticmethod
    def _frame(key: tuple, out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["pipeline", "seq", "action", "replaces", "total_ms"])
        pdf.insert(0, "run_id", key[0])
        return pdf.astype({"run_id": "int64", "seq": "Int64", "replaces": "Int64", "total_ms": "Int64"})

    def close(self) -> None:
        pass


def changes_stream(events: DataFrame, arrival: str, pipelines: int = 2, idle_s: int = 600, late: str = "1 minute") -> DataFrame:
    """The changes of a stream of events, in append mode. A run ends with all its pipelines, or as `expired`
    when event time is idle_s seconds past its last event; what comes after that is a run of its own.

    arrival orders the events of a trigger; events later than `late` are dropped. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.withWatermark("ts", late).select(*_FIELDS, F.col(arrival).alias("arrival"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Run(pipelines, 1000 * idle_s), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def _accepted(events: DataFrame, arrival: str) -> DataFrame:
    """Events in order, up to their pipeline's end."""
    w = Window.partitionBy("run_id", "pipeline").orderBy(arrival)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rising = events.where("seq is not null").withColumn("_most", F.max("seq").over(before)).where("_most is null or seq > _most")
    return rising.withColumn("_ended", F.max(F.col("kind").isin(*ENDS)).over(before)).where("_ended is null or not _ended").drop("_most", "_ended")


def _paired(steps: DataFrame) -> DataFrame:
    """Which seq a step closes, where sub-goals and hops are all known: starts and ends of a key nest, so an
    end closes the last start of its depth."""
    key = ["run_id", "pipeline", "stage", "subgoal_id", "hop"]
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("status") == "started"
    level = steps.withColumn("_sum", F.sum(F.when(starts, 1).otherwise(-1)).over(w))
    level = level.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    level = level.withColumn("_level", F.when(starts, F.col("_depth")).otherwise(F.coalesce(F.lag("_depth").over(Window.partitionBy(*key).orderBy("seq")), F.lit(0))))
    last = Window.partitionBy(*key, "_level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    open_seq = F.last(F.when(starts, F.col("seq")), ignorenulls=True).over(last)
    return level.withColumn("replaces", F.when(~starts & (F.col("_level") > 0), open_seq)).drop("_sum", "_depth", "_level")


def _walked(steps: DataFrame) -> DataFrame:
    """The same for stages of a run in which a sub-goal or a hop is missing, event by event."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        open_steps: dict[int, tuple] = {}
        out = []
        cols = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("seq", "stage", "status", "subgoal_id", "hop")]
        for seq, stage, status, subgoal, hop in zip(*cols, strict=True):
            hop = None if hop is None else int(hop)
            if status == "started":
                open_steps[seq] = (stage, subgoal, hop)
                out.append(None)
            else:
                out.append(closes(open_steps, stage, subgoal, hop))
                open_steps.pop(out[-1], None)
        return pdf.assign(replaces=pd.array(out, "Int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema.fields) + ", replaces long"
    return steps.groupBy("run_id", "pipeline", "stage").applyInPandas(walk, schema)


def changes(events: DataFrame, arrival: str, pipelines: int = 2) -> DataFrame:
    """The changes of a table of events, as changes_stream gives them but for `expired`.

    Windows by run and pipeline; only stages with an unknown sub-goal or hop are walked. Events after the
    run's end are dropped, and so are those with a null seq; a null pipeline is one of its own; no events
    give no rows.
    """
    e = _accepted(events.select(*_FIELDS, arrival), arrival)
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy(arrival))
    closed = e.where(F.col("kind").isin(*ENDS)).withColumn("_n", turn).where(F.col("_n") == pipelines).select("run_id", F.col(arrival).alias("_closed"))
    e = e.join(closed, "run_id", "left").where(F.col("_closed").isNull() | (F.col(arrival) <= F.col("_closed")))
    ends = e.where(F.col("kind").isin(*ENDS))
    ms: Column = F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))
    over = e.where("_closed is not null").groupBy("run_id").agg(ms.alias("ms"))
    none = F.lit(None)
    row = lambda d, **c: d.select("run_id", *[c.get(k, none).cast(t).alias(k) for k, t in (("pipeline", "string"), ("seq", "long"), ("action", "string"), ("replaces", "long"), ("total_ms", "long"))])
    steps = e.where("kind = 'progress'").select("run_id", "pipeline", "seq", "stage", "status", "subgoal_id", "hop")
    vague = Window.partitionBy("run_id", "pipeline", "stage")
    marked = steps.withColumn("_vague", F.max(F.col("subgoal_id").isNull() | F.col("hop").isNull()).over(vague))
    both = _paired(marked.where("not _vague").drop("_vague")).unionByName(_walked(marked.where("_vague").drop("_vague")))
    col = F.col
    out = row(both, pipeline=col("pipeline"), seq=col("seq"), action=F.when(col("replaces").isNull(), "append").otherwise("replace"), replaces=col("replaces"))
    out = out.unionByName(row(e.where(F.coalesce(~F.col("kind").isin("progress", *ENDS), F.lit(True))), pipeline=col("pipeline"), seq=col("seq"), action=F.lit("append")))
    mark = F.lit(None)
    for kind, action in ENDS.items():
        mark = F.when(F.col("kind") == kind, action).otherwise(mark)
    out = out.unionByName(row(ends, pipeline=col("pipeline"), seq=col("seq"), action=mark))
    return out.unionByName(row(over, action=F.lit("run_done"), total_ms=F.col("ms")))
