"""Evaluation sets and scores."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .durable import durable


def breakdown(scores: DataFrame) -> DataFrame:
    """slice, name, metric, mean: the mean of value by synthesizer and by persona (scores: synthesizer,
    persona, metric, value). NaN and null values don't count; null names and slices without a value
    are left out."""
    value = F.when(~F.isnan("value"), F.col("value"))
    sides = F.explode(F.array(F.struct(F.lit("synthesizer").alias("slice"), F.col("synthesizer").alias("name")), F.struct(F.lit("persona").alias("slice"), F.col("persona").alias("name"))))
    each = scores.select("metric", value.alias("value"), sides.alias("s")).where("s.name is not null and value is not null")
    return each.groupBy(F.col("s.slice").alias("slice"), F.col("s.name").alias("name"), "metric").agg(F.avg("value").alias("mean"))


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record of the highest order for each key; nulls in a key are equal."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def positive(weights: DataFrame) -> DataFrame:
    """The kinds (name, weight, ..) that a set is drawn from: those of a weight above 0."""
    return weights.where("weight > 0")


def backfill(weights: DataFrame) -> DataFrame:
    """weights (name, weight, clusters, multi) with the weight of multi-hop kinds without clusters given
    to single-hop, in the first name; moved is what a kind gave."""
    lacking = F.col("multi") & (F.col("clusters") == 0)
    moved = weights.agg(F.coalesce(F.sum(F.when(lacking, F.col("weight"))), F.lit(0.0)).alias("m"), F.min(F.when(~F.col("multi"), F.col("name"))).alias("to"))
    total = weights.agg(F.sum("weight")).first()[0]
    if total is None or not math.isclose(total, 1.0, abs_tol=1e-9):
        raise ValueError(f"weights must sum to 1, not {total}")
    w = weights.join(moved, F.lit(True))
    new = F.when(lacking, 0.0).when(F.col("name") == F.col("to"), F.col("weight") + F.col("m")).otherwise(F.col("weight"))
    return w.select("name", new.alias("weight"), F.when(lacking, F.col("weight")).otherwise(0.0).alias("moved"))


def persona_batches(personas: DataFrame, total: str) -> DataFrame:
    """Each persona's number of samples (personas: set_id, persona, and the set's total): total divided
    evenly, the remainder one each to the first by name."""
    w = Window.partitionBy("set_id")
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy("persona"))
    return personas.select("set_id", "persona", (F.floor(F.col(total) / n) + (rank <= F.col(total) % n).cast("int")).cast("long").alias("samples"))


def promoted(traces: DataFrame) -> DataFrame:
    """Of traces (trace_id, question, assessments: name, value, source_type) that a person approved, the
    expected answer: a person's if there is one, else the first."""
    approved = traces.where(F.exists("assessments", lambda a: (a["name"] == "approve") & (a["value"] == "pass")))
    answers = F.filter("assessments", lambda a: a["name"] == "expected_response")
    human = F.filter(answers, lambda a: a["source_type"] == "HUMAN")
    return approved.select("trace_id", "question", F.coalesce(F.get(human, F.lit(0))["value"], F.get(answers, F.lit(0))["value"]).alias("expected"))


def contract_edges(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, relation between chunks (id): for each relation (source, target, type) of entities (id,
    chunk_ids), their chunks pairwise, other than a chunk with itself. Unknown chunks don't count."""
    e = entities.select("id", F.explode("chunk_ids").alias("chunk")).join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi").distinct()
    s = e.select(F.col("id").alias("source"), F.col("chunk").alias("src"))
    t = e.select(F.col("id").alias("target"), F.col("chunk").alias("dst"))
    return relations.join(s, "source").join(t, "target").where("src <> dst").select("src", "dst", F.col("type").alias("relation")).distinct()


def contract_links(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, kg_relation, source_name, target_name, bidirectional, score: as contract_edges, one for each
    relation between entities (id, name, chunk_ids), which hold in both directions with a score of 1."""
    e = entities.select("id", "name", F.explode("chunk_ids").alias("chunk")).join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi").distinct()
    s = e.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("chunk").alias("src"))
    t = e.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("chunk").alias("dst"))
    out = relations.join(s, "source").join(t, "target").where("src <> dst")
    return out.select("src", "dst", F.col("type").alias("kg_relation"), "source_name", "target_name", F.lit(True).alias("bidirectional"), F.lit(1.0).alias("score"))


def chunk_entities(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, names (each once, in order of the entities' ord) and n (entities with repeats) of each chunk."""
    e = entities.select("ord", "name", F.explode("chunk_ids").alias("chunk")).join(chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi")
    rows = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return e.groupBy("chunk").agg(F.array_distinct(F.transform(rows, lambda x: x["name"])).alias("names"), F.count("*").alias("n"))


def records(samples: DataFrame, model: str | None = None) -> DataFrame:
    """inputs, expectations, source and tags of each sample (user_input, persona_name, reference,
    reference_contexts, synthesizer_name). inputs alone is the identity of a record."""
    from docweir.functions import text as T

    of = F.struct(F.lit("CODE").alias("source_type"), F.struct(F.lit("llm").alias("generator"), F.lit(model).cast("string").alias("model")).alias("source_data"))
    tags = F.struct(F.lit("llm").alias("source"), T.sample_id(F.col("user_input"), F.col("persona_name")).alias("sample_id"), T.hop_type(F.col("synthesizer_name")).alias("hop_type"), F.coalesce("synthesizer_name", F.lit("")).alias("synthesizer_name"), F.lit(model).cast("string").alias("generation_model"))
    return samples.select(
        F.struct(F.col("user_input").alias("question"), "persona_name").alias("inputs"),
        F.struct(F.col("reference").alias("expected_response"), F.coalesce("reference_contexts", F.array().cast("array<string>")).alias("expected_contexts")).alias("expectations"),
        of.alias("source"), tags.alias("tags"))


def rows_from_traces(traces: DataFrame, metrics: list[str]) -> DataFrame:
    """trace_id, synthesizer_name, persona_name and a column for each metric, of traces (trace_id, tags map,
    assessments: name, value as text): values that are numbers, the last of several; true and false are 1 and 0."""
    number = lambda a: F.when(F.lower(a["value"]) == "true", 1.0).when(F.lower(a["value"]) == "false", 0.0).otherwise(F.try_to_number(a["value"], F.lit("S999999999D999999999")).cast("double"))
    of = lambda m: F.transform(F.filter("assessments", lambda a: (a["name"] == m) & number(a).isNotNull()), number)
    return traces.select("trace_id", F.element_at("tags", "synthesizer_name").alias("synthesizer_name"), F.element_at("tags", "persona_name").alias("persona_name"), *[F.try_element_at(of(m), F.lit(-1)).alias(m) for m in metrics])


def collected(chunks: DataFrame, documents: DataFrame, ids: list | None = None) -> DataFrame:
    """chunks (document_id, chunk_index, ..) of the documents (document_id, status) that are indexed: all, or
    those of ids, which must exist and be indexed."""
    d = documents
    if ids is not None:
        asked = documents.sparkSession.createDataFrame([(i,) for i in ids], documents.select("document_id").schema)
        state = asked.join(documents, "document_id", "left").select("document_id", "status").collect()  # a row for each asked id
        missing, early = sorted(r[0] for r in state if r[1] is None), sorted(r[0] for r in state if r[1] not in (None, "indexed"))
        if missing or early:
            raise ValueError(f"documents not found: {missing}; not indexed: {early}")
        d = d.join(asked, "document_id", "left_semi")
    return chunks.join(d.where("status = 'indexed'").select("document_id"), "document_id", "left_semi")


def evidence_metrics(answers: DataFrame) -> DataFrame:
    """technique and the shares of answers (technique, expected and found arrays of chunk ids, current, claims,
    supported, conflict, reported): evidence_coverage, current_version_accuracy, unsupported_conclusions and
    conflict_detection (of those that have a conflict)."""
    cover = F.size(F.array_intersect("expected", "found")) / F.nullif(F.size("expected"), F.lit(0))
    return answers.groupBy("technique").agg(F.avg(cover).alias("evidence_coverage"), F.avg(F.col("current").cast("double")).alias("current_version_accuracy"), (1 - F.sum("supported") / F.nullif(F.sum("claims"), F.lit(0))).alias("unsupported_conclusions"), F.avg(F.when(F.col("conflict"), F.col("reported").cast("double"))).alias("conflict_detection"))


def contract_errors(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """item, error of a knowledge-graph contract: entities without id, name or type, and relations with an
    end that no entity has."""
    lacks = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in ("id", "name", "type")]
    bad = entities.select(F.col("id").cast("string").alias("item"), F.explode(F.array_compact(F.array(*lacks))).alias("error"))
    ids = entities.select("id").distinct()
    ends = [relations.join(ids, relations[c] == ids["id"], "left_anti").select(F.col(c).cast("string").alias("item"), F.lit(f"dangling {c}").alias("error")) for c in ("source", "target")]
    return bad.union(ends[0]).union(ends[1])


def compared(runs: DataFrame) -> DataFrame:
    """sample_id, metric and each run's mean side by side with their difference (runs: technique of `a` or
    `b`, sample_id, metric, value); samples that one lacks stay, with a null."""
    v = F.when(~F.isnan("value"), F.col("value"))
    side = lambda t: F.avg(F.when(F.col("technique") == t, v)).alias(t)
    return runs.groupBy("sample_id", "metric").agg(side("a"), side("b")).withColumn("gain", F.col("b") - F.col("a"))


def token_overlap(answers: DataFrame) -> DataFrame:
    """sample_id, precision and recall of the distinct tokens of contexts against the reference's (answers:
    sample_id, contexts array, reference): what stands in for a judge without a model."""
    from docweir.functions import text as T

    a = answers.select("sample_id", F.array_distinct(T.tokens(F.array_join("contexts", " "))).alias("c"), F.array_distinct(T.tokens(F.col("reference"))).alias("r"))
    both = F.size(F.array_intersect("c", "r"))
    return a.select("sample_id", (both / F.greatest(F.size("c"), F.lit(1))).alias("precision"), (both / F.greatest(F.size("r"), F.lit(1))).alias("recall"))


def ran(samples: DataFrame, techniques: Techniques, names: list[str]) -> DataFrame:
    """technique and answers of each named technique on all samples (question_id, text)."""
    out = None
    for name in names:
        one = techniques.resolve(name)(samples).withColumn("technique", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def raced(questions: DataFrame, techniques: Techniques, names: list[str]) -> DataFrame:
    """pipeline, question_id, answered, contexts, error, returned and total_ms of each named technique on each of the same
    questions (question_id, text), in one table that survives the techniques' sources.

    A technique that fails has a row for each question with the failure's kind in error, and leaves the others
    as they are; a question without contexts isn't answered. total_ms is the wall clock's of the technique's one
    pass over all questions, returned the rows that it gave, counted as they are written.
    """
    spark, out = questions.sparkSession, None
    for name in names:
        answer = techniques.resolve(name)
        began, seen = time.perf_counter(), Observation()
        try:
            a = answer(questions).select("question_id", F.col("contexts").cast("array<string>").alias("contexts"))
            rows = durable(a.observe(seen, F.count("*").alias("n")), f"technique-{name}")
            error, n = F.lit(None).cast("string"), seen.get["n"]
        except Exception as e:  # noqa: BLE001  any failure is the technique's own
            rows, error = spark.createDataFrame([], "question_id long, contexts array<string>"), F.lit(type(e).__name__)
            n = 0
        ms = max(0, round((time.perf_counter() - began) * 1000))
        some = F.coalesce(F.size("contexts") > 0, F.lit(False))
        one = questions.select(F.col("question_id").cast("long").alias("question_id")).join(rows, "question_id", "left")
        one = one.select(F.lit(name).alias("pipeline"), "question_id", some.alias("answered"), "contexts", error.alias("error"), F.lit(n).cast("long").alias("returned"), F.lit(ms).cast("long").alias("total_ms"))
        out = one if out is None else out.unionByName(one)
    return out


def race_summary(rows: DataFrame) -> DataFrame:
    """pipeline, questions, answered, failed and total_ms of raced()."""
    return rows.groupBy("pipeline").agg(F.count("*").alias("questions"), F.count_if("answered").alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.max("total_ms").alias("total_ms"))


class Techniques:
    """Named ways to answer: each takes questions (question_id, text) and gives question_id, contexts."""

    def __init__(self):
        self.known: dict = {}

    def register(self, name: str, answer) -> None:
        self.known[name] = answer

    def resolve(self, name: str):
        if name not in self.known:
            raise ValueError(f"unknown technique {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name]
