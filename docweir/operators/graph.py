"""Operators on a graph of typed entities. vertices: entity_id, entity_type, description, file_path;
edges: src, dst, relation, and properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweir.functions import text as T

#: Relations that go from type to type, and keywords of relations in order.
TRIPLES = [("VanBan", "CAN_CU", "VanBan"), ("VanBan", "THAM_CHIEU", "VanBan"), ("VanBan", "THAY_THE", "VanBan"), ("VanBan", "XUNG_DOT", "VanBan"), ("VanBan", "QUY_DINH", "GiaTriQuyDinh"), ("GiaTriQuyDinh", "AP_DUNG_CHO", "KhaiNiem")]
CITATIONS = ["CAN_CU", "THAY_THE", "THAM_CHIEU", "UU_TIEN_HON"]
KEYWORDS = {
    "CAN_CU": ["căn cứ", "tuân thủ", "phù hợp với", "complies", "based on", "dựa trên"],
    "THAM_CHIEU": ["tham chiếu", "dẫn chiếu", "reference", "refers to", "theo quy định tại"],
    "THAY_THE": ["thay thế", "supersede", "replace", "hết hiệu lực thi hành"],
    "XUNG_DOT": ["xung đột", "mâu thuẫn", "conflict", "trái với", "khác với"],
    "QUY_DINH": ["quy định", "yêu cầu", "phải có", "tối thiểu", "tối đa"],
    "AP_DUNG_CHO": ["áp dụng cho", "applies to", "của", "đối với"],
}


def classify_relation(text):
    """The first relation that has a keyword in the text, else null."""
    low = F.lower(text)
    cases = [(r, reduce(lambda a, b: a | b, [low.contains(k) for k in ks])) for r, ks in KEYWORDS.items()]
    out = F.when(cases[0][1], cases[0][0])
    for r, c in cases[1:]:
        out = out.when(c, r)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree, edges in either direction."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(degrees(edges), vertices.entity_id == F.col("id"), "left_anti")


def checked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a reason: bad_type (an end is missing or has no known type), unclassified, invalid_triple,
    or null if the ontology allows the edge, in either direction."""
    known = {t for a, _, b in TRIPLES for t in (a, b)}
    ends = vertices.select("entity_id", F.when(F.col("entity_type").isin(*known), F.col("entity_type")).alias("type"))
    both = edges.join(ends.select(F.col("entity_id").alias("src"), F.col("type").alias("st")), "src", "left").join(ends.select(F.col("entity_id").alias("dst"), F.col("type").alias("dt")), "dst", "left")
    allowed = reduce(lambda a, b: a | b, [(F.col("relation") == r) & (((F.col("st") == a) & (F.col("dt") == b)) | ((F.col("st") == b) & (F.col("dt") == a))) for a, r, b in TRIPLES])
    reason = F.when(F.col("st").isNull() | F.col("dt").isNull(), "bad_type").when(F.col("relation").isNull(), "unclassified").when(~allowed, "invalid_triple")
    return both.withColumn("reason", reason).drop("st", "dt")


def merged(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends replaced by mapping (old, new): loops go, and of parallel edges the first by
    relation stays."""
    m = mapping.select("old", "new")
    e = edges.join(m.select(F.col("old").alias("src"), F.col("new").alias("s")), "src", "left").join(m.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst", "left")
    e = e.withColumns({"src": F.coalesce("s", "src"), "dst": F.coalesce("d", "dst")}).drop("s", "d").where("src <> dst")
    first = Window.partitionBy("src", "dst").orderBy("relation")
    return e.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def canonical(vertices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """old, new: of the vertices that share a key, the one of the highest degree, then the longest
    description, then the least id, stands for the rest."""
    v = vertices.where(F.col(key).isNotNull()).join(degrees(edges), vertices.entity_id == F.col("id"), "left")
    order = F.struct(-F.coalesce("degree", F.lit(0)), -F.length(F.coalesce("description", F.lit(""))), F.col("entity_id"))
    best = v.groupBy(key).agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    return v.join(best, key).select(F.col("entity_id").alias("old"), F.col("best.entity_id").alias("new")).where("old <> new")


def dedupe_parallel(edges: DataFrame, properties: tuple[str, ...] = ("partial", "scope", "uu_tien_cho", "loai")) -> DataFrame:
    """Of an edge and its reverse of the same relation, the one with special properties (those of
    `properties` that edges have; false counts as none) stays, else the one with more of them, else the one
    from the smaller id."""
    has = [p for p in properties if p in edges.columns]
    weight = sum((F.coalesce(F.col(p), F.lit(False)).cast("int") if edges.schema[p].dataType.typeName() == "boolean" else F.col(p).isNotNull().cast("int") for p in has), F.lit(0))
    e = edges.withColumn("_weight", weight)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", F.col("_weight").alias("_other"))
    # several reverse edges of a relation count as the heaviest of them
    back = back.where("relation is not null").groupBy("src", "dst", "relation").agg(F.max("_other").alias("_other"))
    both = e.join(back, ["src", "dst", "relation"], "left")
    wins = F.col("_other").isNull() | (F.col("_weight") > F.col("_other")) | ((F.col("_weight") == F.col("_other")) & (F.col("src") < F.col("dst")))
    return both.where(wins).select(*edges.columns)


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """Distinct citation edges on paths of up to hops edges, in either direction, from starts (id)."""
    e = edges.where(F.col("relation").isin(*CITATIONS)).distinct()
    front, out = starts.select("id").distinct(), None
    for _ in range(hops):
        hit = e.join(front, e.src == front.id, "left_semi").union(e.join(front, e.dst == front.id, "left_semi")).distinct()
        out = hit if out is None else out.union(hit).distinct()
        front = hit.select(F.col("src").alias("id")).union(hit.select(F.col("dst").alias("id"))).distinct()
    return out


def concept_bundle(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept, value, document: values that apply to each concept (id) and documents that set them."""
    v = edges.where("relation = 'AP_DUNG_CHO'").select(F.col("dst").alias("concept"), F.col("src").alias("value"))
    d = edges.where("relation = 'QUY_DINH'").select(F.col("dst").alias("value"), F.col("src").alias("document"))
    return concepts.select(F.col("id").alias("concept")).join(v, "concept", "left").join(d, "value", "left").select("concept", "value", "document")


def link_by_words(values: DataFrame, concepts: DataFrame, least: float = 0.5) -> DataFrame:
    """id, concept, overlap: for each value (id, name) the concept (id, name) that shares most
    significant words, at least that part of its own; ties go to the smaller concept id."""
    v = values.select("id", F.explode(T.significant_words(F.col("name"))).alias("word"))
    c = concepts.select(F.col("id").alias("concept"), T.significant_words(F.col("name")).alias("w")).select("concept", F.size("w").alias("size"), F.explode("w").alias("word"))
    hits = v.join(c, "word").groupBy("id", "concept", "size").agg(F.count("*").alias("overlap")).where(F.col("overlap") / F.col("size") >= least)
    best = hits.groupBy("id").agg(F.max(F.struct("overlap", (-F.col("concept")).alias("least"))).alias("b"))
    return best.select("id", (-F.col("b.least")).alias("concept"), F.col("b.overlap").alias("overlap"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type, n; null types are left out."""
    n = vertices.where("entity_type is not null").groupBy(F.lit("node").alias("kind"), F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
    e = edges.where("relation is not null").groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("type")).agg(F.count("*").alias("n"))
    return n.union(e)


def without_document(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the vertices of documents (document_id) and their edges."""
    v = vertices.join(gone, "document_id", "left_anti")
    ids = v.select("entity_id")
    return v, edges.join(ids, edges.src == ids.entity_id, "left_semi").join(ids, edges.dst == ids.entity_id, "left_semi")


def provenance(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst of new QUY_DINH edges: from each file_path's first document to its values and concepts,
    where no edge of any kind joins the two yet."""
    v = vertices.where("file_path is not null")
    own = v.where("entity_type = 'VanBan'").groupBy("file_path").agg(F.min("entity_id").alias("src"))
    to = v.where("entity_type in ('GiaTriQuyDinh', 'KhaiNiem')").select("file_path", F.col("entity_id").alias("dst"))
    return to.join(own, "file_path").select("src", "dst").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def stamped(vertices: DataFrame, documents: DataFrame) -> DataFrame:
    """vertices with a null document_id filled from the document (document_id, title) of their file_path."""
    d = documents.groupBy(F.col("title").alias("file_path")).agg(F.min("document_id").alias("_id"))
    return vertices.join(d, "file_path", "left").withColumn("document_id", F.coalesce("document_id", "_id")).drop("_id")


def contains_lookup(numbers: DataFrame, vertices: DataFrame, width: int | None = None) -> DataFrame:
    """number, entity_id: the least id that contains each number (number, of width characters or fewer;
    without it, as long as the longest).

    Every stretch of an id as long as a number is looked up, so the join is on equality; an id has as
    many stretches as its length for each length that numbers have.
    """
    width = width or numbers.agg(F.max(F.length("number"))).first()[0] or 1
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.length("entity_id"), F.lit(width))))
    parts = vertices.select("entity_id", sizes.alias("size"))
    starts = F.explode(F.sequence(F.lit(1), F.length("entity_id") - F.col("size") + 1))
    parts = parts.select("entity_id", "size", starts.alias("at")).select("entity_id", F.substring("entity_id", F.col("at"), F.col("size")).alias("number"))
    return numbers.select("number").distinct().join(parts, "number").groupBy("number").agg(F.min("entity_id").alias("entity_id"))


def canonicalized(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of the same normalised entity_id as one, the longest description kept, and edges between
    them with their weights summed; loops go."""
    name = lambda c: T.normalize_name(F.col(c))
    v = vertices.groupBy(name("entity_id").alias("entity_id")).agg(F.max_by("description", F.struct(F.length("description"), F.col("entity_id"))).alias("description"), F.count("*").alias("members"))
    e = edges.select(name("src").alias("src"), name("dst").alias("dst"), "relation", "weight").where("src <> dst")
    return v, e.groupBy("src", "dst", "relation").agg(F.sum("weight").alias("weight"))
