"""Versions of documents seeded by keys that occur in their names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lifecycle
from .durable import durable

#: Characters of keys that are looked for at once; more keys are looked for group by group.
KEYS = 4 << 20


def _hits(names: DataFrame, keys: list[str]) -> DataFrame:
    """id, ord and key of each of the keys that occurs in a name (id, ord, name). One automaton of all keys reads a
    name once, whatever their number."""
    shared = names.sparkSession.sparkContext.broadcast(keys)  # KEYS characters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k in shared.value:
            machine.add_word(k, k)
        machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for i, name in enumerate(b.column(2).to_pylist()):
                some = sorted({k for _, k in machine.iter(name)}) if name else []
                rows += [i] * len(some)
                found += some
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(found, pa.string())], b.schema.names[:2] + ["key"])

    kinds = dict(names.dtypes)
    return names.select("id", "ord", "name").mapInArrow(run, f"id {kinds['id']}, ord {kinds['ord']}, key string")


def first_with_key(documents: DataFrame, keys: DataFrame, group: int = KEYS) -> DataFrame:
    """key and id: for each key (distinct rows of keys) the first document, by created_at and id, whose
    `filename title`, lower-cased, contains it. documents: id, filename, title, created_at.

    Null names count as empty. A null key, an empty one and one that no name has give no row; no documents give none.
    """
    k = durable(keys.select("key").distinct().where("key <> ''"), "seed-keys")
    total = k.agg(F.sum(F.length("key"))).first()[0] or 0
    groups = -(-total // group)
    name = F.lower(F.concat(F.coalesce("filename", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    names = documents.select("id", F.col("created_at").alias("ord"), name.alias("name"))
    out = None
    for g in range(groups):
        own = [r[0] for r in k.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).collect()]
        if not own:
            continue
        hits = _hits(names, own)
        out = hits if out is None else out.union(hits)
    if out is None:
        return names.select(F.lit("").alias("key"), "id").limit(0)
    # the first of a key is found in each task before the shuffle
    return out.groupBy("key").agg(F.min_by("id", F.struct(F.col("ord").isNull(), "ord", "id")).alias("id"))


def seeded(documents: DataFrame, seeds: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """documents (of lifecycle.py, with filename, title, doc_no, version_label and supersession_note) with what
    seeds (ord, key, doc_no, version_label, effective_date) say of the first document of each key, the seed of
    the greatest ord where several do; an unknown is_active becomes true. chains (old_key, new_key, note): the
    first document of the old key is superseded by that of the new one as this takes effect; chains without
    both are left out."""
    first = durable(first_with_key(documents, seeds), "seeds")
    rows = seeds.join(first, "key").groupBy("id").agg(F.max_by(F.struct("doc_no", "version_label", "effective_date"), "ord").alias("_seed"))
    d = documents.join(rows, "id", "left")
    hit = F.col("_seed").isNotNull()
    told = {c: F.when(hit, F.col("_seed")[c]).otherwise(F.col(c)) for c in ("doc_no", "version_label", "effective_date")}
    d = d.withColumns(told | {"is_active": F.when(hit, F.coalesce("is_active", F.lit(True))).otherwise(F.col("is_active"))}).select(*documents.columns)
    if chains is None:
        return d
    d = durable(d, "seeded")
    ends = first.select(F.col("key").alias("old_key"), F.col("id").alias("old")), first.select(F.col("key").alias("new_key"), F.col("id").alias("new"))
    acts = chains.join(ends[0], "old_key").join(ends[1], "new_key").join(d.select(F.col("id").alias("new"), "effective_date"), "new")
    acts = durable(acts.select("old", "new", "effective_date", "note"), "seed-chains")
    out = lifecycle.supersede(d, acts.drop("note")).join(acts.select(F.col("old").alias("id"), F.col("note").alias("_note")), "id", "left")
    return out.withColumn("supersession_note", F.coalesce("_note", "supersession_note")).select(*documents.columns)
