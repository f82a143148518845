"""Progress events of runs: run_id, seq, stage, status, and optional subgoal_id and hop. Runs of several pipelines and
streams of them are in runs.py.

An event whose seq is not above all before it in its run is dropped. An event other than `started`
takes the place of the latest open `started` of its stage with the same sub-goal and hop, or else
one where these don't contradict; if there is none it is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order(events: DataFrame, arrival: str) -> DataFrame:
    """Events that come (by arrival) with a seq above all earlier ones of their run."""
    w = Window.partitionBy("run_id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    most = F.max("seq").over(w)
    return events.withColumn("_most", most).where(F.col("_most").isNull() | (F.col("seq") > F.col("_most"))).drop("_most")


def upsert(current: list[dict], event: dict) -> list[dict]:
    """current with one more event of its run."""
    if current and event["seq"] <= max(e["seq"] for e in current):
        return current
    if event["status"] != "started":
        same = lambda e, loose: all(e[k] == event[k] or loose and (e[k] is None or event[k] is None) for k in ("subgoal_id", "hop"))
        for loose in (False, True):
            for i in range(len(current) - 1, -1, -1):
                if current[i]["status"] == "started" and current[i]["stage"] == event["stage"] and same(current[i], loose):
                    return [*current[:i], event, *current[i + 1 :]]
    return [*current, event]


def windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by type in tumbling windows of event time, on a batch or a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
