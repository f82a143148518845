"""Entities that stand for the same thing as one, links of values to concepts, targets of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir.functions import text as T

from . import graph, vectors
from .durable import components, durable

MERGED_FROM = "<MERGED_FROM>"


def _longest(members: DataFrame, key: str) -> DataFrame:
    """old, new: of the entities that share a key, that of the longest description (then the least id)
    stands for the rest."""
    order = F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("l"), F.col("entity_id"))
    best = members.groupBy(key).agg(F.min(order).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    return members.join(best, key).select(F.col("entity_id").alias("old"), F.col("_best.entity_id").alias("new")).where("old <> new")


def diacritics_mapping(vertices: DataFrame, entity_type: str) -> DataFrame:
    """old, new of the entities of a type whose names differ in marks, case and outer blanks only."""
    v = vertices.where(F.col("entity_type") == entity_type)
    key = T.strip(F.lower(T.strip_diacritics(F.col("entity_id"))))
    return _longest(v.withColumn("_key", key).where("_key <> ''"), "_key")


def fuzzy_mapping(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """old, new of the entities that confirmed pairs (a, b: entity ids) connect, whatever the order in
    which these were found."""
    number = F.xxhash64("entity_id")
    ids = durable(vertices.select("entity_id", "description", number.alias("_id")), "entities")
    edges = pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    groups = components(edges, "entities").withColumnsRenamed({"id": "_id", "component": "_key"})
    return _longest(ids.join(groups, "_id"), "_key")


def merged_vertices(vertices: DataFrame, mapping: DataFrame) -> DataFrame:
    """vertices without the old ones of mapping (old, new), which leave their descriptions to the new one,
    after a tag each, and their ids as aliases, in the order of the ids."""
    gone = vertices.join(mapping, vertices.entity_id == mapping.old).groupBy("new").agg(F.sort_array(F.collect_list(F.struct("old", F.coalesce("description", F.lit("")).alias("said")))).alias("_from"))
    v = vertices.join(mapping.select(F.col("old").alias("entity_id")), "entity_id", "left_anti").join(gone, vertices.entity_id == gone.new, "left").drop("new")
    more = F.array_join(F.transform("_from", lambda m: F.concat(F.lit(f" {MERGED_FROM} "), m["said"])), "")
    aliases = F.coalesce(F.transform("_from", lambda m: m["old"]), F.array().cast("array<string>"))
    return v.withColumn("description", F.when(F.col("_from").isNull(), F.col("description")).otherwise(F.concat(F.coalesce("description", F.lit("")), more))).withColumn("aliases", aliases).drop("_from")


def without_link(values: DataFrame, edges: DataFrame, relation: str = "AP_DUNG_CHO") -> DataFrame:
    """values (entity_id, ..) from which no edge of the relation starts."""
    return values.join(edges.where(F.col("relation") == relation).select(F.col("src").alias("entity_id")), "entity_id", "left_anti")


def link_concepts(values: DataFrame, concepts: DataFrame, cosine: float = 0.8, least: float = 0.5) -> DataFrame:
    """id, concept, score, via (`words` or `embedding`): each value (id, name, embedding) with the concept
    (id, name, embedding) that shares most words, else with the nearest by cosine of at least `cosine`."""
    words = durable(graph.link_by_words(values, concepts, least), "word-links")
    rest = values.join(words, "id", "left_anti").where("embedding is not null")
    # ids of both sides are apart for the search, which leaves out a vector of the query's own id
    c = concepts.select((-F.col("id") - 1).alias("vec_id"), "embedding")
    near = vectors.search(c, rest.select(F.col("id").alias("query_id"), "embedding"), 1, least=cosine)
    one = words.select("id", "concept", F.col("overlap").cast("double").alias("score"), F.lit("words").alias("via"))
    return one.unionByName(near.select(F.col("query_id").alias("id"), (-F.col("vec_id") - 1).alias("concept"), "score", F.lit("embedding").alias("via")))


def own_documents(vertices: DataFrame) -> DataFrame:
    """title, entity_id: the document entity of each file_path, the least id of several."""
    return vertices.where("entity_type = 'VanBan' and file_path is not null").groupBy(F.col("file_path").alias("title")).agg(F.min("entity_id").alias("entity_id"))


def citation_targets(citations: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, new vertices) of citations (title, target, type, ..).

    The source is the document's own entity; without one there is no edge, and none to a number that is
    part of its own id. A target is the least document entity whose id contains the number, or else a new
    vertex of this id.
    """
    own = own_documents(vertices).withColumnRenamed("entity_id", "src")
    c = citations.join(own, "title").where(~F.contains(F.col("src"), F.col("target")))
    known = graph.contains_lookup(c.select(F.col("target").alias("number")), vertices.where("entity_type = 'VanBan'"))
    c = c.join(known.withColumnRenamed("number", "target"), "target", "left").withColumn("dst", F.coalesce("entity_id", "target"))
    new = c.where("entity_id is null").select(F.col("target").alias("entity_id")).distinct()
    said = F.lit("external document, known by its number only")
    new = new.select("entity_id", F.lit("VanBan").alias("entity_type"), said.alias("description"))
    return c.drop("entity_id", "target").withColumnRenamed("type", "relation"), new


def entity_type(name: Column, known: list[str]) -> Column:
    """The type of that name whatever its case, else null."""
    out = F.lit(None).cast("string")
    for k in known:
        out = F.when(F.lower(T.strip(name)) == k.lower(), k).otherwise(out)
    return out


def resolved(vertices: DataFrame, edges: DataFrame, number: str = "number") -> tuple[DataFrame, DataFrame]:
    """The graph after its clean-up in order: documents of one number as one, parallel edges once,
    concepts that differ in marks as one. Each step's tables are written, so that the next starts from them."""
    for k, mapping in enumerate((lambda v, e: graph.canonical(v, e, number), lambda v, e: diacritics_mapping(v, "KhaiNiem"))):
        m = durable(mapping(vertices, edges), f"mapping-{k}")
        vertices = durable(merged_vertices(vertices.drop("aliases"), m), f"vertices-{k}")
        edges = durable(graph.merged(edges, m), f"edges-{k}")
        if k == 0:
            edges = durable(graph.dedupe_parallel(edges), "edges-once")
    return vertices, edges


def in_catalog(concepts: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """concept, doc_id, share: concepts (concept, name, docs array) whose significant words (three letters or
    more, without what stands in brackets at the end) are in the catalog names (doc_id, name) of a document
    that they are said to be in, a share of at least `least` of them."""
    bare = T.strip(F.regexp_replace("name", r"\s*\([^()]*\)\s*$", ""))
    c = concepts.select("concept", F.explode("docs").alias("doc_id"), T.significant_words(bare, 3).alias("w")).where(F.size("w") > 0)
    blob = names.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(T.normalize_name(F.col("name")))), " | ").alias("blob"))
    share = F.size(F.filter("w", lambda w: F.contains(F.col("blob"), w))) / F.size("w")
    return c.join(blob, "doc_id").select("concept", "doc_id", share.alias("share")).where(F.col("share") >= least)


