"""Ingest of a corpus of files: every file comes to a terminal state.

A file stream hands new files to a batch, which parses, joins pages and cuts chunks. What a batch makes is
written below its number, so that a batch that failed in the middle and runs again writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.operators import splitting
from docweir.sources import io

FILES = "path string, modificationTime timestamp, length long, content binary"
#: (path, content) -> document_id, page_number, parsed, text_layer
Parser = Callable[[DataFrame], DataFrame]
#: What a file without any text fails with, and one that no batch came to in time.
EMPTY, LATE = "no text on any page", "not done in time"


def document_id(path: str = "path") -> F.Column:
    return F.xxhash64(F.col(path))


def text_pages(files: DataFrame) -> DataFrame:
    """A parser of plain text: pages end at form feeds. Bytes that aren't UTF-8 give no text."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    page = F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f")).alias("page_number", "parsed")
    return files.select(document_id().alias("document_id"), page).withColumn("text_layer", F.lit(None).cast("string"))


def _title() -> F.Column:
    return F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.[^.]*$", "")


def ingested(files: DataFrame, parser: Parser = text_pages, size: int = 1000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of files (path, content). documents: document_id, path, title, status (`indexed` or
    `failed`), error and chunk_count; chunks: those of split_text by document_id. Only texts that parse have chunks."""
    joined = io.joined_pages(io.parsed_pages(parser(files)))
    chunks = splitting.split_text(joined.where("status <> 'failed'"), size, overlap, doc_id="document_id").withColumnRenamed("doc_id", "document_id")
    per = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    d = files.select(document_id().alias("document_id"), "path", _title().alias("title")).join(joined.select("document_id", "status"), "document_id", "left").join(per, "document_id", "left")
    ok = F.coalesce(F.col("chunk_count") > 0, F.lit(False)) & (F.coalesce("status", F.lit("failed")) != "failed")
    return d.select("document_id", "path", "title", F.when(ok, "indexed").otherwise("failed").alias("status"), F.when(~ok, EMPTY).alias("error"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")), chunks


def run(spark: SparkSession, source: str, target: str, pattern: str = "*.txt", parser: Parser = text_pages, timeout_s: float = 7200, files_per_batch: int = 1000, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Ingests the files of source that target hasn't seen, and gives status(): the state of every file.

    target has documents and chunks, a folder for each batch, and the stream's checkpoint. Files that are not
    done after timeout_s are `failed` in the result (LATE), and done by the next run. A batch's failure is
    raised; the next run repeats the batch and nothing else.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        documents, chunks = ingested(batch.select("path", "content"), parser, size, overlap)
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        documents.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")

    q = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    if not q.awaitTermination(timeout_s):
        q.stop()
    return status(spark, source, target, pattern)


def tables(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of all batches."""
    read = lambda name, schema: spark.read.schema(f"{schema}, batch long").option("basePath", f"{target}/{name}").option("mode", "PERMISSIVE").parquet(f"{target}/{name}")
    return read("documents", "document_id long, path string, title string, status string, error string, chunk_count long"), read("chunks", splitting.CHUNK.replace("doc_id", "document_id"))


def status(spark: SparkSession, source: str, target: str, pattern: str = "*.txt") -> DataFrame:
    """document_id, path, title, status, error and chunk_count of every file of source, ingested or not."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source).select("path")
    done, _ = tables(spark, target)
    out = there.select(document_id().alias("document_id"), "path", _title().alias("title")).join(done.select("document_id", "status", "error", "chunk_count"), "document_id", "left")
    late = F.col("status").isNull()
    return out.withColumns({"error": F.when(late, LATE).otherwise(F.col("error")), "status": F.coalesce("status", F.lit("failed")), "chunk_count": F.coalesce("chunk_count", F.lit(0))})


def summary(states: DataFrame) -> DataFrame:
    """status, documents and chunks of status()."""
    return states.groupBy("status").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))
