"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweir.llm import bpe, common, jaccard_join, line_dedup, mixing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts go with them; rows need no key, so repeated
    rows and null ids are judged each; columns stay as they are; no rows give none."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier place repeats go; every document stays. A row is cut by the ranges of
    its own id and text; null texts and null ids stay as they are; no rows give none."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id. Word shingles of five at a
    similarity of 0.8 or more, as near-duplicate stages take. Null and empty texts and null ids link with
    nothing and stay; rows that repeat an id stay or go together; no rows give none."""
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each document and time that its words are taken. Null and
    empty texts are never taken; rows that repeat an id or have none are taken each for itself; no rows give
    none."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, a row for each row; a null text counts
    as empty; no rows give none."""
    return bpe.token_digests(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: No SQL: expectation-maximisation, rolling hashes and BPE are beyond it; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
