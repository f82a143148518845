"""Citations between documents, found by their numbers and the nearest verb."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions import text as T

#: The shape of a document number, verbs by relation in order of precedence, and what
#: tells that a replacement is partial and what it leaves in force.
NUMBER = r"\d{1,4}/\d{4}/(?:NĐ-CP|TT-NHNN|QĐ-DDB)"
VERBS = [
    ("THAY_THE", r"thay\s+thế"),
    ("UU_TIEN_HON", r"ưu\s+tiên"),
    ("THAM_CHIEU", r"áp\s+dụng\s+thay\s+cho|(?<!thay\s)\bthay\s+cho\b"),
    ("THAM_CHIEU", r"tham\s+chiếu|dẫn\s+chiếu|hiện\s+hành"),
    ("CAN_CU", r"theo\s+Điều\s+\d+|căn\s+cứ|tuân\s+thủ|phù\s+hợp\s+với|theo\s+quy\s+định\s+tại"),
]
#: The word that each form of a verb begins with: without it in a window there is nothing to look for.
BEGINS = [["thay"], ["ưu"], ["áp", "thay"], ["tham", "dẫn", "hiện"], ["theo", "căn", "tuân", "phù"]]
PARTIAL = r"một\s+phần|riêng|tiếp\s+tục\s+có\s+hiệu\s+lực|giữ\s+hiệu\s+lực"
SCOPE = r"Phụ\s+lục\s+\d+[^.;\n]{0,80}"
BEFORE, AFTER = 150, 300


def classify(before: Column, after: Column, low: list[Column] | None = None) -> Column:
    """The relation of the verb nearest to the number; of equally near ones the first, before first. low: both in small
    letters, if they are there already."""
    seen, low = [], [F.lower(before), F.lower(after)] if low is None else low
    for i, (name, verb) in enumerate(VERBS):
        some = [reduce(lambda a, b: a | b, [x.contains(w) for w in BEGINS[i]]) for x in low]
        head = F.when(some[0], F.regexp_extract(before, rf"(?siuU)^(.*(?:{verb}))", 1)).otherwise("")
        at = F.when(some[1], F.regexp_instr(after, F.lit(rf"(?siuU)(?:{verb})"))).otherwise(0)
        seen.append(F.when(head != "", F.struct((F.length(before) - F.length(head)).alias("far"), F.lit(2 * i).alias("turn"), F.lit(name).alias("type"))))
        seen.append(F.when(at > 0, F.struct((at - 1).alias("far"), F.lit(2 * i + 1).alias("turn"), F.lit(name).alias("type"))))
    return F.array_min(F.filter(F.array(*seen), lambda s: s.isNotNull()))["type"]


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos (1..), target, type, partial, scope, evidence of each number with a verb near it."""
    parts, numbers = F.split(F.col("t"), NUMBER), F.regexp_extract_all(F.col("t"), F.lit(NUMBER), F.lit(0))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("numbers", numbers).where(F.size("numbers") > 0).withColumn("parts", parts)
    size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    each = found.select("doc_id", "t", "parts", "numbers", F.posexplode("numbers").alias("i", "target"))
    start = size(F.col("parts"), F.col("i") + 1) + size(F.col("numbers"), F.col("i"))
    end = start + F.length("target")
    # rows of one are exploded, so that windows and types are made once and not anew by each filter and column that uses them
    once = lambda df, keep, *made: df.select(*keep, F.inline(F.array(F.struct(*made))))
    here = once(each, ["doc_id", "target"], (F.col("i") + 1).alias("pos"), F.substring("t", F.greatest(start - BEFORE, F.lit(0)) + 1, start - F.greatest(start - BEFORE, F.lit(0))).alias("before"), F.substring("t", end + 1, F.lit(AFTER)).alias("after"))
    here = once(here, ["doc_id", "target", "pos", "before", "after"], F.lower("before").alias("_b"), F.lower("after").alias("_a"))
    typed = here.select("doc_id", "target", "pos", "before", "after", F.explode(F.array_compact(F.array(classify(F.col("before"), F.col("after"), [F.col("_b"), F.col("_a")])))).alias("type"))
    partial = (F.col("type") == "THAY_THE") & F.col("after").rlike(rf"(?iuU){PARTIAL}")
    scope = T.strip(F.nullif(F.regexp_extract("after", rf"(?iuU){SCOPE}", 0), F.lit("")))
    evidence = F.concat(F.lit("..."), F.right(T.strip(F.col("before")), F.lit(60)), F.lit(" ["), F.col("target"), F.lit("] "), F.left(T.strip(F.col("after")), F.lit(80)), F.lit("..."))
    return typed.select("doc_id", "pos", "target", "type", partial.alias("partial"), F.when(partial, scope).alias("scope"), evidence.alias("evidence"))


def last_wins(citations: DataFrame) -> DataFrame:
    """One edge of each doc_id and target: the type of the last citation, with the properties of the
    first citation of the run of that type which ends there."""
    all_ = Window.partitionBy("doc_id", "target")
    changed = F.when(F.lag("type").over(all_.orderBy("pos")).eqNullSafe(F.col("type")), None).otherwise(F.col("pos"))
    # windows of one key, so that citations are found and sorted once
    runs = citations.where("doc_id is not null and target is not null").withColumn("_changed", changed)
    last = runs.withColumns({"_last": F.max("_changed").over(all_), "citations": F.count("*").over(all_)}).where("pos = _last")
    return last.select("doc_id", "target", "type", "partial", "scope", "pos", "citations")
