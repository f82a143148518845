"""Graphs in GraphML files, and what they have in common.

Spark's XML reader splits files at their elements, so that a large file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key string, _VALUE string>>"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("pathGlobFilter", "*.graphml").schema(schema).load(path)
    return rows.withColumn("graph", F.regexp_replace(F.col("_metadata.file_name"), r"\.graphml$", ""))


def _named(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and properties by name; data of a key that isn't declared keeps the key's id as its name."""
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    data = numbered.select("graph", "_n", F.explode("data").alias("d")).select("graph", "_n", F.col("d._key").alias("key"), F.coalesce("d._VALUE", F.lit("")).alias("value"))
    named = data.join(keys, ["graph", "key"], "left").groupBy("_n").agg(F.map_from_entries(F.array_distinct(F.array_sort(F.collect_list(F.struct(F.coalesce("name", "key"), "value"))))).alias("properties"))
    none = F.create_map().cast("map<string,string>")
    return numbered.join(named, "_n", "left").select("graph", *columns, F.coalesce("properties", none).alias("properties"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the .graphml files at path. vertices: graph (the file's name), entity_id and
    properties (a map); edges: graph, src, dst and properties. Keys are declared in each file."""
    keys = _elements(spark, path, "key", "_id string, `_attr.name` string").select("graph", F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"))
    nodes = _elements(spark, path, "node", f"_id string, {_DATA}").withColumn("entity_id", F.col("_id"))
    edges = _elements(spark, path, "edge", f"_source string, _target string, {_DATA}").withColumns({"src": F.col("_source"), "dst": F.col("_target")})
    return _named(nodes, keys, ["entity_id"]), _named(edges, keys, ["src", "dst"])


def compared(vertices: DataFrame, edges: DataFrame, type_key: str = "entity_type") -> DataFrame:
    """graph, nodes, edges, types (a map of counts; `UNKNOWN` without one), isolated (nodes without an edge) and dangling
    (edges with an end that is no node of their graph)."""
    kind = F.coalesce(F.nullif(F.element_at("properties", type_key), F.lit("")), F.lit("UNKNOWN"))
    by_type = vertices.groupBy("graph", kind.alias("type")).agg(F.count("*").alias("n"))
    out = by_type.groupBy("graph").agg(F.sum("n").alias("nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    alone = vertices.join(ends, ["graph", "entity_id"], "left_anti").groupBy("graph").agg(F.count("*").alias("isolated"))
    lost = ends.join(vertices.select("graph", "entity_id"), ["graph", "entity_id"], "left_anti")
    hangs = edges.join(lost.select("graph", F.col("entity_id").alias("src"), F.lit(1).alias("_a")), ["graph", "src"], "left").join(lost.select("graph", F.col("entity_id").alias("dst"), F.lit(1).alias("_b")), ["graph", "dst"], "left")
    per = hangs.groupBy("graph").agg(F.count("*").alias("edges"), F.count_if(F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("dangling"))
    zero = F.lit(0)
    return out.join(per, "graph", "left").join(alone, "graph", "left").select("graph", "nodes", F.coalesce("edges", zero).alias("edges"), "types", F.coalesce("isolated", zero).alias("isolated"), F.coalesce("dangling", zero).alias("dangling"))
