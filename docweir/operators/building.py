"""Building a graph step by step, each of which may fail alone, and components that are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, resolution
from .durable import components, durable

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _merging(mapping: Callable[[DataFrame, DataFrame], DataFrame]) -> Step:
    def step(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        m = durable(mapping(v, e), "mapping")
        names = m.select(F.col("new").alias("entity_id"), F.col("old").alias("alias"))
        if "aliases" in v.columns:  # of earlier steps, which go to what their vertex is now
            old = v.select("entity_id", F.explode("aliases").alias("alias")).join(m.select(F.col("old").alias("entity_id"), "new"), "entity_id", "left")
            names = names.unionByName(old.select(F.coalesce("new", "entity_id").alias("entity_id"), "alias"))
        names = names.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
        one = resolution.merged_vertices(v.drop("aliases"), m).drop("aliases").join(names, "entity_id", "left")
        return one.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), graph.merged(e, m)

    return step


def default_steps(number: str = "number") -> list[tuple[str, Step]]:
    """What follows extraction, in order: documents of one number, parallel edges, concepts that differ in marks."""
    return [
        ("documents", _merging(lambda v, e: graph.canonical(v, e, number))),
        ("parallel", lambda v, e: (v, graph.dedupe_parallel(e))),
        ("marks", _merging(lambda v, e: resolution.diacritics_mapping(v, "KhaiNiem"))),
    ]


def renamed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """New edges with the ends that vertices (entity_id, aliases) know by other names: a graph that has been
    built takes in more documents so, and the steps then only merge what is new."""
    m = vertices.select(F.explode("aliases").alias("old"), F.col("entity_id").alias("new"))
    return graph.merged(edges, m)


def built(vertices: DataFrame, edges: DataFrame, steps: list[tuple[str, Step]] | None = None, required: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, log) after the steps. Each step's tables are written before the next begins; a step that
    fails leaves the tables as they were and the next one goes on, but the first `required` steps raise. log: ord,
    step, status (`done` or `failed`), error, vertices and edges (how many there are then)."""
    spark, rows = vertices.sparkSession, []
    for k, (name, step) in enumerate(default_steps() if steps is None else steps):
        error = None
        try:
            v, e = step(vertices, edges)
            vertices, edges = durable(v, f"built-{name}"), durable(e, f"built-{name}-edges")
        except Exception as x:  # noqa: BLE001  any failure is the step's own
            if k < required:
                raise
            error = f"{type(x).__name__}: {x}"[:2000]
        rows.append((k, name, "failed" if error else "done", error, vertices.count(), edges.count()))
    return vertices, edges, spark.createDataFrame(rows, "ord int, step string, status string, error string, vertices long, edges long")


def joined(labels: DataFrame, added: DataFrame) -> DataFrame:
    """labels (id, component: the least id that it reaches) after edges were added (a, b): as components() of all
    edges. Only the added edges meet labels; their components are joined among themselves, and just the labels
    of components that merged are rewritten."""
    ends = durable(added.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "added")
    label = lambda side: F.coalesce(F.col(f"_{side}"), F.col(side))
    named = ends
    for side in ("a", "b"):
        named = named.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    merged = durable(components(named.select(label("a").alias("a"), label("b").alias("b")), "merged"), "merged")
    new = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().join(labels.select("id"), "id", "left_anti")
    every = labels.select("id", "component").unionByName(new.withColumn("component", F.col("id")))
    to = merged.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("_to"))
    return durable(every.join(to, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "labels")


def parted(labels: DataFrame, removed: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after edges were removed (a, b); edges (a, b): those that are left. Only components that lost an edge are
    found anew, from the edges inside them; ids without an edge have no label."""
    hit = labels.join(removed.select(F.col("a").alias("id")).union(removed.select("b")).distinct(), "id", "left_semi").select("component").distinct()
    hit = durable(hit, "parted")
    inside = labels.join(hit, "component", "left_semi").select("id")
    again = components(edges.join(inside.select(F.col("id").alias("a")), "a", "left_semi"), "parted-components")
    return durable(labels.join(hit, "component", "left_anti").select("id", "component").unionByName(again.select("id", "component")), "labels")
