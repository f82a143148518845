"""From questions to evidence: plan, gather, assess, again up to a budget of hops, finalize.

Evidence comes through two channels that stay apart: passages (vector and keyword search, fused) and facts of the
graph (citations around the documents that a goal hit, and bundles of the concepts that it names). All questions and
goals of a hop are one batch; a goal leaves as it is satisfied, and the driver only learns whether any is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions import text as T
from docweir.operators import chunking, graph, graphsearch, prompts, vectors
from docweir.operators.durable import durable
from docweir.sources.providers import ClausePlanner, Planner

#: Fixed value: what a goal without evidence of the least score lacks.
WEAK = "Chưa có đoạn đủ liên quan."


@dataclass(frozen=True)
class Sources:
    """What is searched. docs: doc_id, text, title, and if there is_active; vectors: doc_id, embedding;
    vertices (entity_id, entity_type, file_path), edges (src, dst, relation) and concepts (name, embedding): the graph;
    outlines: doc_id, outline. Those that are missing are channels that give nothing."""

    docs: DataFrame
    vectors: DataFrame | None = None
    vertices: DataFrame | None = None
    edges: DataFrame | None = None
    concepts: DataFrame | None = None
    outlines: DataFrame | None = None


#: (goals, evidence, facts) -> goal_id, satisfied, note: what a judge says of some goals
Judge = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def plan(questions: DataFrame, planner: Planner | None = None) -> DataFrame:
    """query_id, question_id, subgoal, description and the other columns (but text) of questions (question_id, text)."""
    planner = planner or ClausePlanner()
    rest = [c for c in questions.columns if c not in ("question_id", "text")]
    goals = questions.select("question_id", *rest, F.posexplode(planner.plan(F.col("text"))).alias("i", "description"))
    return goals.select((F.col("question_id") * 8 + F.col("i")).alias("query_id"), "question_id", F.concat(F.lit("g"), F.col("i") + 1).alias("subgoal"), "description", *rest)


def nearest(goals: DataFrame, sources: Sources, k: int) -> DataFrame | None:
    """query_id, doc_id and score of the max(2k, 10) nearest passages of goals (query_id, embedding)."""
    if sources.vectors is None:
        return None
    active = sources.vectors.join(sources.docs.select("doc_id"), "doc_id", "left_semi")
    q = goals.where("embedding is not null").select("query_id", "embedding")
    return durable(vectors.search(active, q, max(2 * k, 10), vec_id="doc_id", own=True).withColumnRenamed("vec_id", "doc_id"), "dense")


def passages(goals: DataFrame, sources: Sources, ready: tuple, k: int, alpha: float = 0.5, dense: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score and rank of the k best passages of goals (query_id, text, embedding, hybrid): of
    vectors and keywords fused, max(2k, 10) of each, or without hybrid of vectors alone. dense: nearest(), if it is there already."""
    index, weights = ready
    keyword = chunking.bm25(sources.docs, goals.where("hybrid").select("query_id", "text"), max(2 * k, 10), ready=index, weights=weights)
    dense = nearest(goals, sources, k) if dense is None else dense
    dense = keyword.limit(0).select("query_id", "doc_id", "score") if dense is None else dense
    both = goals.select("query_id", "hybrid")
    alone = dense.join(both.where("not hybrid"), "query_id", "left_semi")
    fused = vectors.fuse(dense.join(both.where("hybrid"), "query_id", "left_semi"), keyword, k, alpha)
    return fused.unionByName(chunking.top(alone.select("query_id", "doc_id", "score"), "query_id", F.col("score"), F.col("doc_id"), k))


def outlines(goals: DataFrame, sources: Sources, k: int) -> DataFrame:
    """question_id and outline: the catalogs of the documents among the k nearest to each question
    (question_id, embedding), in that order, a blank line between."""
    near = vectors.search(sources.vectors.join(sources.docs.select("doc_id"), "doc_id", "left_semi"), goals.where("embedding is not null").select(F.col("question_id").alias("query_id"), "embedding"), k, vec_id="doc_id", own=True)
    hit = near.withColumnRenamed("vec_id", "doc_id").join(sources.outlines, "doc_id")
    each = hit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "outline"))).alias("o"))
    return each.select(F.col("query_id").alias("question_id"), F.array_join(F.transform("o", lambda x: x["outline"]), "\n\n").alias("outline"))


def goal_facts(goals: DataFrame, hits: DataFrame, sources: Sources, hops: int = 1, top_k: int = 5, cap: int = 6) -> DataFrame:
    """query_id, rank and facts of goals (query_id, text, embedding): citations around the documents that they hit,
    then bundles of the concepts that they name, cap at most."""
    titles = hits.join(sources.docs.select("doc_id", "title"), "doc_id").select("query_id", "title").join(goals.select("query_id"), "query_id", "left_semi")
    matched = None if sources.concepts is None else graphsearch.match_concepts(goals.select("query_id", "text", "embedding"), sources.concepts, top_k)
    return graphsearch.found_facts(sources.vertices, sources.edges, titles, matched, hops, cap)


def cited_elsewhere(goals: DataFrame, evidence: DataFrame, facts: DataFrame, docs: DataFrame, least: float = 0.35) -> DataFrame:
    """goal_id, satisfied and note: a judge that needs no model. A goal is open as long as a citation among its
    facts names a document that its passages don't have (the note is its title, to be searched for), and else
    if it has neither facts nor a passage of the least score."""
    best = evidence.groupBy("query_id").agg(F.max("score").alias("best"))
    there = evidence.join(docs.select("doc_id", "title"), "doc_id").select("query_id", "title").distinct()
    ends = facts.where(F.col("relation").isin(*graph.CITATIONS)).select("query_id", "hop", "rank", F.posexplode(F.array("source_entity", "target_entity")).alias("end", "title"))
    lacks = ends.join(there, ["query_id", "title"], "left_anti").groupBy("query_id").agg(F.min_by("title", F.struct("hop", "rank", "end")).alias("lacks"))
    some = facts.select("query_id").distinct().withColumn("some", F.lit(True))
    g = goals.select("query_id").join(best, "query_id", "left").join(lacks, "query_id", "left").join(some, "query_id", "left")
    ok = F.coalesce(F.col("best") >= least, F.lit(False)) | F.coalesce("some", F.lit(False))
    return g.select(F.col("query_id").alias("goal_id"), (F.col("lacks").isNull() & ok).alias("satisfied"), F.coalesce("lacks", F.when(ok, "").otherwise(WEAK)).alias("note"))


def retrieve(questions: DataFrame, sources: Sources | DataFrame, top_k: int = 5, hops: int = 3, least: float = 0.35, planner: Planner | None = None, judge: Judge | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(citations, facts, goals) of questions (question_id, text; and if there embedding, hybrid, graph).

    citations: question_id, subgoal, doc_id, score and rank; facts: question_id, subgoal, rank and the facts; goals:
    question_id, subgoal, description, satisfied, note and hops (how many it took). The judge's verdicts are joined
    by goal_id, goals that it leaves out are satisfied if they have a passage; a goal's later hops are searched
    with the note. Inactive documents take no part. A question without text is a goal without hits.
    """
    if isinstance(sources, DataFrame):
        sources = Sources(sources if "title" in sources.columns else sources.withColumn("title", F.lit(None).cast("string")))
    if "is_active" in sources.docs.columns:
        sources = Sources(sources.docs.where(~F.col("is_active").eqNullSafe(F.lit(False))), sources.vectors, sources.vertices, sources.edges, sources.concepts, sources.outlines)
    for c, default in (("embedding", F.lit(None).cast("array<float>")), ("hybrid", F.lit(True)), ("graph", F.lit(True))):
        if c not in questions.columns:
            questions = questions.withColumn(c, default)
    content = sources.docs.select("doc_id", T.final_content(F.col("title"), F.lit(None).cast("string"), F.col("text")).alias("text"))
    index = chunking.index(content)
    ready = index, durable(chunking.idf(index), "idf")
    judge = judge or (lambda g, e, f: cited_elsewhere(g, e, f, sources.docs, least))
    goals = durable(plan(questions, planner).withColumns({"satisfied": F.lit(False), "note": F.lit(None).cast("string"), "hops": F.lit(0)}), "goals")
    evidence = facts = None
    dense = nearest(goals, sources, top_k)  # later hops change a goal's text alone
    for hop in range(hops):
        left = goals.where("not satisfied")
        if left.isEmpty():
            break
        q = durable(left.withColumn("text", T.broaden(F.col("description"), F.lit(hop), F.col("note"))).select("query_id", "text", "embedding", "hybrid", "graph"), "goal-queries")
        hits = durable(passages(q, sources, ready, top_k, dense=dense).withColumn("hop", F.lit(hop)), "hits")
        evidence = hits if evidence is None else durable(_first(evidence.unionByName(hits), ["query_id", "doc_id"]), "evidence")
        if sources.edges is not None:
            new = goal_facts(q.where("graph"), hits, sources).withColumn("hop", F.lit(hop))
            facts = durable(new if facts is None else _first(facts.unionByName(new), ["query_id", "fact_id"]), "facts")
        elif facts is None:
            facts = hits.limit(0).select("query_id", F.lit("").alias("source_entity"), F.lit("").alias("target_entity"), F.lit("").alias("relation"), F.lit("").alias("fact_id"), F.lit(1.0).alias("score"), "rank", "hop")
        said = judge(left, evidence, facts)
        judged = prompts.verdicts(left.drop("satisfied", "note").withColumn("goal_id", F.col("query_id")), said, evidence.select(F.col("query_id").alias("goal_id"))).drop("goal_id")
        goals = durable(goals.where("satisfied").unionByName(judged.withColumn("hops", F.lit(hop + 1))), "goals")
    if evidence is None:  # no questions
        evidence = goals.select("query_id", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("hop"))
        facts = goals.select("query_id", F.lit("").alias("fact_id"), F.lit(1.0).alias("score"), F.lit(0).alias("hop"))
    of = goals.select("query_id", "question_id", "subgoal")
    picked = vectors.finalize(evidence.drop("rank").join(of, "query_id").drop("query_id"), top_k)
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "subgoal", "doc_id")))
    said = graphsearch.merged_facts(facts.drop("rank").join(of, "query_id").drop("query_id"))
    return picked, said, goals.select("question_id", "subgoal", "description", "satisfied", "note", "hops")


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key that came at the first hop."""
    w = Window.partitionBy(*key).orderBy("hop")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coverage(goals: DataFrame) -> DataFrame:
    """question_id, subgoals, satisfied, all_satisfied and hops of goals."""
    return goals.groupBy("question_id").agg(F.count("*").alias("subgoals"), F.count_if("satisfied").alias("satisfied"), F.bool_and("satisfied").alias("all_satisfied"), F.max("hops").alias("hops"))
