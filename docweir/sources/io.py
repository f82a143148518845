"""Readers and writers: JSON lines, keyed upserts, schema migration, blobs, snapshots, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweir.functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines; blank lines don't count."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema).alias("r")).select("r.*")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples with defaults: contexts empty, sample_id from question and persona."""
    raw = read_jsonl(spark, path, "user_input string, reference string, reference_contexts array<string>, synthesizer_name string, persona_name string, sample_id string")
    return raw.withColumns({"reference_contexts": F.coalesce("reference_contexts", F.array().cast("array<string>")), "sample_id": F.coalesce("sample_id", T.sample_id(F.col("user_input"), F.col("persona_name")))})


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order and nulls kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows in place of its rows of the same keys; columns that one side lacks are null."""
    same = [table[k].eqNullSafe(rows[k]) for k in keys]
    kept = table.join(rows.select(*keys).distinct(), same, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def migrated(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """table with the columns (type, default) that it lacks; the rest as it is."""
    return table.withColumns({c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in table.columns})


def blobs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files below root, of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def delete_prefix(spark: SparkSession, path: str) -> bool:
    """Deletes what lies below path; False if there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def snapshot(table: DataFrame, path: str) -> int:
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path).count()


def page_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags, runs of white space as one space."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


def parsed_pages(pages: DataFrame, fallback: bool = True) -> DataFrame:
    """document_id, page_number, text, used_fallback of pages (.., parsed, text_layer): the text layer where
    nothing was parsed."""
    blank = T.strip(F.coalesce("parsed", F.lit(""))) == ""
    use = blank & F.lit(fallback) & (T.strip(F.coalesce("text_layer", F.lit(""))) != "")
    return pages.select("document_id", "page_number", F.when(use, F.col("text_layer")).otherwise(F.coalesce("parsed", F.lit(""))).alias("text"), use.alias("used_fallback"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """document_id, text (pages that aren't blank, in order, a blank line between), status, n_fallback."""
    p = pages.withColumn("t", T.strip(F.col("text")))
    rows = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("page_number", "t"))))
    out = p.groupBy("document_id").agg(rows.alias("r"), F.count_if("used_fallback").alias("n_fallback"))
    return out.select("document_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("text"), F.when(F.size("r") == 0, "failed").otherwise("parsed").alias("status"), "n_fallback")


def load_dataset(spark: SparkSession, source: str, named: dict[str, str]) -> DataFrame:
    """Samples of a .jsonl path that exists, else of the dataset of that name (name: path of a table)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source) if source.endswith(".jsonl") else None
    if p is not None and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return read_samples(spark, source)
    if source not in named:
        raise ValueError(f"no such file or dataset: {source}; known: {', '.join(sorted(named))}")
    return spark.read.parquet(named[source])


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """name and role_description of a JSON list of personas; an error says what is wrong with it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise ValueError(f"no personas at {path}")
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<map<string,string>>").alias("list"))
    if rows.where("list is null or size(list) = 0").limit(1).count():
        raise ValueError("personas must be a list that is not empty")
    each = rows.select(F.posexplode("list").alias("i", "p"))
    bad = each.where("p is null or not map_contains_key(p, 'name') or not map_contains_key(p, 'role_description')").select("i").orderBy("i").limit(1).collect()
    if bad:
        raise ValueError(f"persona {bad[0][0]} lacks a name or a role_description")
    return each.select(F.col("p")["name"].alias("name"), F.col("p")["role_description"].alias("role_description"))


CONTRACT = "version string, entities array<struct<id:string,name:string,type:string,chunk_ids:array<string>>>, relations array<struct<source:string,target:string,type:string>>"


def read_contract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a knowledge-graph contract; ord tells an entity's place in it."""
    c = spark.read.schema(CONTRACT).json(path, multiLine=True)
    return c.select(F.posexplode("entities").alias("ord", "e")).select("ord", "e.*"), c.select(F.explode("relations").alias("r")).select("r.*")


def read_ontology(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types: name, description; relations: name, ord, keyword; triples: src, relation, dst, in both
    directions) of an ontology's YAML text, a short file that the driver reads."""
    import yaml

    doc = yaml.safe_load(text) or {}
    types = [(n, (s or {}).get("description", "")) for n, s in doc.get("entity_types", {}).items()]
    words = [(n, k, w) for k, (n, s) in enumerate(doc.get("relation_types", {}).items()) for w in (s or {}).get("keywords", [])]
    triples = sorted({t for a, r, b in doc.get("allowed_triples", []) for t in ((a, r, b), (b, r, a))})
    return spark.createDataFrame(types, "name string, description string"), spark.createDataFrame(words, "name string, ord int, keyword string"), spark.createDataFrame(triples, "src string, relation string, dst string")


def gated(events: DataFrame, column: str = "event", version: int = 1, key: str = "v") -> DataFrame:
    """events whose JSON is an object of the version; what is malformed or of another is left out."""
    v = F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "int")
    return events.where(v == version)
