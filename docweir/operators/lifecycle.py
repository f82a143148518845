"""Versions and validity of documents: id, is_active, effective_date, expiry_date, supersedes_id,
superseded_by_id, created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import components


def lifecycle() -> Column:
    return F.when(F.coalesce("is_active", F.lit(True)), "active").when(F.col("superseded_by_id").isNotNull(), "superseded").otherwise("expired")


def searchable_vectors(docs: DataFrame) -> DataFrame:
    """A missing flag counts as active."""
    return docs.where(~F.col("is_active").eqNullSafe(F.lit(False)))


def searchable_keywords(docs: DataFrame) -> DataFrame:
    """A missing flag doesn't count as active."""
    return docs.where("is_active")


def supersede(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """docs after actions (old, new, effective_date), one at most for each document on either side.
    The old one becomes inactive and expires when the new one takes effect; that becomes active."""
    if not actions.where("old = new").isEmpty():
        raise ValueError("a document can't supersede itself")
    as_old = actions.select(F.col("old").alias("id"), F.col("new").alias("_by"), F.col("effective_date").alias("_expires"))
    as_new = actions.select(F.col("new").alias("id"), F.col("old").alias("_of"), F.col("effective_date").alias("_from"))
    d = docs.join(as_old, "id", "left").join(as_new, "id", "left")
    return d.withColumns({
        "is_active": F.when(F.col("_by").isNotNull(), False).when(F.col("_of").isNotNull(), True).otherwise(F.col("is_active")),
        "expiry_date": F.coalesce("_expires", "expiry_date"),
        "superseded_by_id": F.coalesce("_by", "superseded_by_id"),
        "supersedes_id": F.coalesce("_of", "supersedes_id"),
        "effective_date": F.coalesce("effective_date", "_from"),
    }).select(*docs.columns)


def reactivate(docs: DataFrame, ids: DataFrame) -> DataFrame:
    d = docs.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    hit = F.col("_hit").isNotNull()
    return d.withColumns({"is_active": F.when(hit, True).otherwise(F.col("is_active")), "expiry_date": F.when(~hit, F.col("expiry_date")), "superseded_by_id": F.when(~hit, F.col("superseded_by_id"))}).select(*docs.columns)


def version_chains(docs: DataFrame) -> DataFrame:
    """id, chain (the least id that it reaches) and version (1.. by effective or else creation date, then
    id): documents linked in either direction; ids that don't exist are left out."""
    links = docs.select(F.col("id").alias("a"), F.explode(F.array("supersedes_id", "superseded_by_id")).alias("b")).where("b is not null")
    links = links.join(docs.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    c = components(links, "chains")
    d = docs.join(c, "id", "left").withColumn("chain", F.coalesce("component", "id"))
    order = Window.partitionBy("chain").orderBy(F.coalesce("effective_date", "created_at"), "id")
    return d.select("id", "chain", F.row_number().over(order).alias("version"))


def expire(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """docs after actions (id, effective_date): inactive, and expired from that date."""
    d = docs.join(actions.select("id", F.col("effective_date").alias("_from"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.col("_hit").isNotNull()
    return d.withColumns({"is_active": F.when(hit, False).otherwise(F.col("is_active")), "expiry_date": F.when(hit, F.col("_from")).otherwise(F.col("expiry_date"))}).select(*docs.columns)


def recovered(docs: DataFrame) -> DataFrame:
    """docs (graph_status, ..) whose graph was being built when the process ended, as failed."""
    return docs.withColumn("graph_status", F.when(F.col("graph_status") == "building", "failed").otherwise(F.col("graph_status")))


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the documents that are gone; null keys stay."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def reset(docs: DataFrame, tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """docs (status, graph_status, ..) and their tables as before the ids were processed, but for those
    whose graph is being built."""
    free = docs.join(ids.select(key).distinct(), key, "left_semi").where("graph_status is distinct from 'building'").select(key)
    d = docs.join(free.withColumn("_hit", F.lit(True)), key, "left")
    d = d.withColumn("status", F.when(F.col("_hit").isNotNull(), "uploaded").otherwise(F.col("status"))).select(*docs.columns)
    return d, without(tables, free, key)


def eligible(docs: DataFrame, categories: list[str], enabled: bool = True) -> DataFrame:
    """docs whose category takes part in the graph, none if that is off."""
    return docs.where(F.col("category").isin(*categories) & F.lit(enabled))


def replaceable(docs: DataFrame) -> DataFrame:
    """docs that a new version can replace: active, indexed, and no successor of another."""
    return docs.where("is_active and status = 'indexed' and supersedes_id is null")
