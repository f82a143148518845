"""What goes to a model and what comes back: hit records, context blocks, prompts, verdicts, tool traces, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions import text as T

#: The headings of a prompt's parts.
CONTEXT, CATALOG, GRAPH = "NGỮ CẢNH:", "CATALOG:", "TRI THỨC ĐỒ THỊ (quan hệ giữa văn bản/khái niệm — KHÔNG phải trích dẫn nguyên văn):"
MISSING, QUESTION = "PHẦN CÒN THIẾU BẰNG CHỨNG (nêu rõ trong câu trả lời, KHÔNG bịa):", "CÂU HỎI: "
#: What stands for an empty context, a note that is missing, and goals without evidence.
NO_CONTEXT, NO_NOTE, NO_EVIDENCE = "(không có ngữ cảnh)", "chưa đủ bằng chứng", "Không có bằng chứng."


def hit_records(hits: DataFrame) -> DataFrame:
    """hits with defaults: texts empty, numbers -1, scores 0."""
    fill = {"string": F.lit(""), "bigint": F.lit(-1), "int": F.lit(-1), "double": F.lit(0.0), "float": F.lit(0.0)}
    return hits.select(*[F.coalesce(c, fill[t].cast(t)).alias(c) if t in fill else F.col(c) for c, t in hits.dtypes])


def hit_documents(hits: DataFrame, documents: DataFrame, active_only: bool = True) -> DataFrame:
    """question_id, doc_id, rank and the columns of documents (doc_id, ..) of the documents of hits
    (question_id, rank, doc_id), each once, in the order in which they come; inactive ones (is_active false)
    are left out with active_only."""
    first = hits.where("doc_id is not null").groupBy("question_id", "doc_id").agg(F.min("rank").alias("first"))
    d = documents.where(~F.col("is_active").eqNullSafe(F.lit(False))) if active_only and "is_active" in documents.columns else documents
    w = Window.partitionBy("question_id").orderBy("first", "doc_id")
    return first.join(d, "doc_id").withColumn("rank", F.row_number().over(w)).drop("first")


def snippet(content: Column, limit: int = 500) -> Column:
    """One line of the content's first characters."""
    return F.left(F.regexp_replace(T.strip(F.coalesce(content, F.lit(""))), "\n", " "), F.lit(limit))


def fact_line(source: Column, relation: Column, target: Column, properties: Column, title: Column) -> Column:
    """`source --relation--> target (properties) [nguồn: title]`, the last two where there are any."""
    some = F.when(F.size(properties) > 0, F.concat(F.lit(" ("), F.to_json(properties), F.lit(")"))).otherwise("")
    of = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" [nguồn: "), title, F.lit("]"))).otherwise("")
    return F.concat(source, F.lit(" --"), relation, F.lit("--> "), target, some, of)


def context(citations: DataFrame) -> DataFrame:
    """question_id and context: numbered blocks of citations (question_id, rank, title, chunk_index, content),
    a blank line between; a question's citations are as many as its search gives."""
    block = F.format_string("[%d] (Tài liệu: %s, đoạn #%d)\n%s", F.col("n"), F.col("title"), F.col("chunk_index"), F.col("content"))
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    b = citations.withColumn("n", n).select("question_id", F.struct("n", block.alias("block")).alias("b"))
    return b.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n").alias("context"))


def prompt(questions: DataFrame, contexts: DataFrame, goals: DataFrame, facts: DataFrame | None = None, outlines: DataFrame | None = None) -> DataFrame:
    """question_id and prompt of questions (question_id, text): context, outlines (question_id, outline), facts (question_id, rank, line), what
    is without evidence (goals: question_id, subgoal, description, satisfied, note), and the question."""
    lacks = goals.where(~F.col("satisfied")).select("question_id", F.struct("subgoal", F.concat(F.lit("- "), "description", F.lit(": "), F.coalesce(F.nullif("note", F.lit("")), F.lit(NO_NOTE))).alias("line")).alias("g"))
    lacks = lacks.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda x: x["line"]), "\n").alias("missing"))
    q = questions.join(contexts, "question_id", "left").join(lacks, "question_id", "left")
    said = catalogs = F.lit(None).cast("string")
    if facts is not None:
        f = facts.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("facts"))
        q, said = q.join(f, "question_id", "left"), F.col("facts")
    if outlines is not None:
        q, catalogs = q.join(outlines, "question_id", "left"), F.nullif(T.strip(F.col("outline")), F.lit(""))
    part = lambda head, body: F.concat(F.lit(f"{head}\n"), body)
    parts = F.array(part(CONTEXT, F.coalesce("context", F.lit(NO_CONTEXT))), part(CATALOG, catalogs), part(GRAPH, said), part(MISSING, F.col("missing")), F.concat(F.lit(QUESTION), F.col("text")))
    return q.select("question_id", F.array_join(F.array_compact(parts), "\n\n").alias("prompt"))


def verdicts(goals: DataFrame, results: DataFrame, evidence: DataFrame) -> DataFrame:
    """goals (goal_id, ..) with satisfied and note: as results (goal_id, satisfied, note) say, else by whether
    there is evidence (goal_id) at all."""
    r = results.select("goal_id", F.coalesce("satisfied", F.lit(False)).alias("_ok"), T.strip(F.coalesce("note", F.lit(""))).alias("_note"))
    e = evidence.select("goal_id").distinct().withColumn("_some", F.lit(True))
    some = F.coalesce("_some", F.lit(False))
    out = goals.join(r, "goal_id", "left").join(e, "goal_id", "left")
    return out.withColumns({"satisfied": F.coalesce("_ok", some), "note": F.coalesce("_note", F.when(some, "").otherwise(NO_EVIDENCE))}).drop("_ok", "_note", "_some")


def tool_trace(calls: DataFrame, results: DataFrame) -> DataFrame:
    """call_id, tool, args, hit_count of the calls (call_id, tool, args) that results (call_id, content: JSON)
    answer; content that is no list counts as no hits."""
    return calls.join(results, "call_id").select("call_id", "tool", "args", F.coalesce(F.json_array_length("content"), F.lit(0)).alias("hit_count"))


def run_summary(events: DataFrame) -> DataFrame:
    """run_id, completed, latest (label of the last event), last_failed, interrupted (something started,
    nothing failed and the run is not active) of events (run_id, seq, label, status, active)."""
    failed = F.col("status") == "failed"
    stops = ~F.bool_or("active") & ~F.bool_or(failed) & F.bool_or(F.col("status") == "started")
    return events.groupBy("run_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.max_by("label", "seq").alias("latest"), F.max_by("label", F.when(failed, F.col("seq"))).alias("last_failed"), stops.alias("interrupted"))


#: Headings of what a judge of goals reads, and what stands for none.
EVIDENCE, GRAPH_EVIDENCE, NONE, NO_FACTS = "Bằng chứng văn bản:", "Bằng chứng đồ thị:", "  (chưa có bằng chứng)", "  (chưa có bằng chứng đồ thị)"


def judge_blocks(goals: DataFrame, evidence: DataFrame, facts: DataFrame, most: int = 6) -> DataFrame:
    """goal_id and block: what a judge reads of each goal (goal_id, subgoal, description): its first `most` passages
    (goal_id, rank, content) as snippets, and its first `most` facts (goal_id, rank, line)."""

    def lines(rows: DataFrame, body: Column, name: str) -> DataFrame:
        w = Window.partitionBy("goal_id").orderBy("rank")
        first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("goal_id", F.struct("_n", F.concat(F.lit("  - "), body).alias("line")).alias("r"))
        return first.groupBy("goal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias(name))

    g = goals.join(lines(evidence, snippet(F.col("content")), "_passages"), "goal_id", "left").join(lines(facts, F.col("line"), "_facts"), "goal_id", "left")
    head = F.concat(F.lit("["), "subgoal", F.lit("] "), "description")
    return g.select("goal_id", F.concat_ws("\n", head, F.lit(EVIDENCE), F.coalesce("_passages", F.lit(NONE)), F.lit(GRAPH_EVIDENCE), F.coalesce("_facts", F.lit(NO_FACTS))).alias("block"))
