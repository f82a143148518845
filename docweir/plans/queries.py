"""The queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweir.functions import text as T
from docweir.operators import catalog, chunking, citations, closest, evalkit, graph, lifecycle, vectors
from docweir.sources import io
from docweir.streaming import progress

from .tables import SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the derived tables, for the oracle queries.
_WITH = {k: f"{k} as materialized ({v})" for k, v in SQL.items()}
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_ASCII = r"[ \t\r\n\f\x0B]+"


def query(sql: str | None = None, uses: str = ""):
    """Registers a query by its function's name; sql may use the derived tables named in uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ctes = ", ".join(_WITH[u] for u in uses.split())
            body = sql.strip()
            if ctes:
                body = f"with recursive {ctes}, {body[5:]}" if body.startswith("with ") else f"with {ctes} {body}"
            ORACLES[f.__name__] = body
        return f

    return add


@query(rf"select doc_id, cast(len({_TOKENS}) as bigint) as n_tokens, cast(len(list_filter(regexp_split_to_array(text, '{_ASCII}'), lambda t: t <> '')) as bigint) as n_words from documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), T.token_count(F.col("text")).cast("long").alias("n_words"))


@query(rf"select conv_id, turn, trim(regexp_replace(text, '{_ASCII}', ' ', 'g')) as question, lower(trim(regexp_replace(text, '{_ASCII}', ' ', 'g'))) as name from conversations")
def normalize_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.normalize_question(F.col("text")).alias("question"), T.normalize_name(F.col("text")).alias("name"))


@query(rf"""with t as (select distinct doc_id, unnest({_TOKENS}) as term from documents), s as (select doc_id, term, strip_accents(translate(term, 'đĐ', 'dD')) as skeleton from t)
select skeleton, count(distinct term) as spellings, count(distinct doc_id) as documents, min(term) as first_spelling from s group by skeleton having count(distinct term) > 1""")
def strip_diacritics_groups(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    by = t.withColumn("skeleton", T.strip_diacritics(F.col("term"))).groupBy("skeleton").agg(F.countDistinct("term").alias("spellings"), F.countDistinct("doc_id").alias("documents"), F.min("term").alias("first_spelling"))
    return by.where("spellings > 1")


_CHUNKS = rf"""w as (select doc_id, source, list_filter(regexp_split_to_array(text, '{_ASCII}'), lambda t: t <> '') as w from documents),
c as (select doc_id, source, w, unnest(generate_series(0, greatest(0, cast(ceil((len(w) - 200) / 160.0) as bigint)))) as i from w where len(w) > 0),
chunk as (select doc_id, source, i as chunk_index, array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') as raw_text, len(w[i * 160 + 1 : i * 160 + 200]) as n from c)"""


@query(f"with {_CHUNKS} select doc_id, cast(chunk_index as bigint) as chunk_index, cast(chunk_index * 160 as bigint) as first_word, cast(n as bigint) as token_count, md5(raw_text) as text_md5 from chunk")
def chunk_split(spark, sf):
    c = chunking.chunks(table(spark, sf, "documents"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("first_word").cast("long").alias("first_word"), F.col("token_count").cast("long").alias("token_count"), F.md5("raw_text").alias("text_md5"))


@query(f"with {_CHUNKS} select doc_id, cast(chunk_index as bigint) as chunk_index, md5(concat(source, chr(10), chr(10), raw_text)) as content_md5 from chunk")
def final_content(spark, sf):
    docs = table(spark, sf, "documents")
    c = chunking.chunks(docs).join(docs.select("doc_id", "source"), "doc_id")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(T.final_content(F.col("source"), F.lit(None).cast("string"), F.col("raw_text"))).alias("content_md5"))


_BM25 = rf"""tok as materialized (select doc_id, {_TOKENS} as t from documents), post as materialized (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from tok) x group by all),
n as materialized (select count(*) as n, avg(len(t)) as avgdl from tok),
raw as materialized (select term, ln(any_value(n.n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, n group by term),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({_TOKENS}) as term from benchmark) y group by all),
hits as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / n.avgdl))), 6) as score from post join q using (term) join idf using (term), n group by all),
keyword as (select * from hits where score > 0 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10)"""
_DENSE = """dense as (select q.vec_id as query_id, e.vec_id as doc_id, list_inner_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) + 1e-9) as score
from embeddings q join embeddings e on q.vec_id <> e.vec_id where {where} qualify row_number() over (partition by q.vec_id order by score desc, e.vec_id) <= 10)"""


def four(score: str):
    """A positive score to 4 decimals as SQL rounds it, the number as it is and not its decimal digits."""
    return F.floor(F.col(score) * 1e4 + 0.5) / 1e4


def _keyword(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return chunking.bm25(table(spark, sf, "documents"), q, 10)


@query(f"with {_BM25} select query_id, doc_id, round(score, 4) as score from keyword")
def bm25_topk(spark, sf):
    return _keyword(spark, sf).select("query_id", "doc_id", four("score").alias("score"))


def _every_50th(v: DataFrame) -> DataFrame:
    """The stated query set of a search: every row whose id is divisible by 50, against all rows."""
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("with " + _DENSE.format(where="q.vec_id % 50 = 0") + " select query_id, doc_id as vec_id, round(score, 6) as score from dense")
def dense_multi_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return vectors.search(v, _every_50th(v), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("with " + _DENSE.format(where="q.vec_id % 50 = 0 and e.label in (1, 3, 5) and e.label is distinct from 9") + " select query_id, doc_id as vec_id, round(score, 6) as score from dense")
def dense_doc_filter(spark, sf):
    v = table(spark, sf, "embeddings")
    return vectors.search(v.where(F.col("label").isin(1, 3, 5)), _every_50th(v), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_PAIRS = """with v as materialized (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
p as (select a.vec_id as a, b.vec_id as b, list_inner_product(a.e, b.e) / (a.n * b.n + 1e-9) as score from v a join v b on a.vec_id < b.vec_id)
select a, b, round(score, 6) as score from p where score >= 0.35 order by p.score desc, a desc, b desc limit 60"""


@query(_PAIRS)
def fuzzy_pairs(spark, sf):
    return closest.best_pairs(table(spark, sf, "embeddings"), 60, 0.35).select("a", "b", F.round("score", 6).alias("score"))


_FUSE = """kn as (select query_id, doc_id, 0.5 * score / max(score) over (partition by query_id) as part from keyword), dn as (select query_id, doc_id, 0.5 * score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) as part from dense),
fused as (select query_id, doc_id, round(sum(part), 4) as score from (select * from kn union all select * from dn) z group by all)"""


@query(f"with {_BM25}, " + _DENSE.format(where="q.vec_id in (select item_id from benchmark)") + f", {_FUSE} select query_id, doc_id, score from fused qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5")
def hybrid_fuse(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    dense = vectors.search(v, q, 10).withColumnRenamed("vec_id", "doc_id")
    return vectors.fuse(dense, _keyword(spark, sf), 5).select("query_id", "doc_id", "score")


_GOALS = "with " + _DENSE.format(where="q.vec_id % 50 = 0") + ", ev as (select query_id // 200 as question_id, query_id as subgoal, doc_id, score from dense)"


def _evidence(spark, sf):
    v = table(spark, sf, "embeddings")
    hits = vectors.search(v, _every_50th(v), 10)
    return hits.select(F.expr("query_id div 200").alias("question_id"), F.col("query_id").alias("subgoal"), F.lit(0).alias("hop"), F.col("vec_id").alias("doc_id"), "score")


@query(_GOALS + ", best as (select * from ev qualify row_number() over (partition by question_id, subgoal order by score desc, doc_id) <= 5) select question_id, subgoal, doc_id, round(score, 6) as score from best qualify row_number() over (partition by question_id, doc_id order by subgoal) = 1")
def subgoal_finalize(spark, sf):
    return vectors.finalize(_evidence(spark, sf), 5).withColumn("score", F.round("score", 6))


@query(_GOALS + ", b as (select question_id, subgoal, max(score) as best from ev group by all) select question_id, count(*) as subgoals, count(*) filter (best >= 0.4) as satisfied, bool_and(best >= 0.4) as all_satisfied from b group by question_id")
def coverage_heuristic(spark, sf):
    return vectors.coverage(_evidence(spark, sf), 0.4)


_TREE = """with p as (select doc_id, ord, [a, b, c] as path from paths),
clean as (select doc_id, ord, path from p where not list_bool_or(list_transform(path, lambda n: trim(n) = '' or length(trim(n)) > 120 or not regexp_matches(n, '[A-Za-zÀ-ỹ]')))),
k as (select doc_id, ord, path, list_transform(path, lambda n: lower(trim(n))) as keys from clean),
s as (select doc_id, ord, case when keys[1] = keys[2] and keys[2] = keys[3] then [path[1]] when keys[1] = keys[2] then [path[1], path[3]] when keys[2] = keys[3] then [path[1], path[2]] else path end as path from k),
d as (select doc_id, ord, path[1:n] as path from (select *, unnest(generate_series(1, len(path))) as n from s) x),
m as (select doc_id, list_transform(path, lambda n: lower(trim(n))) as key, arg_min(path[len(path)], ord) as name, min(ord) as ord from d group by all),
tree as (select * from m where exists (select 1 from m b where b.doc_id = m.doc_id and b.key[1] = m.key[1] and len(b.key) > 1))"""


def _paths(spark, sf):
    return table(spark, sf, "paths").select("doc_id", "ord", F.array("a", "b", "c").alias("path"))


@query(_TREE + " select doc_id, array_to_string(key, ' > ') as key, name, ord, cast(len(key) as bigint) as depth from tree", "paths")
def catalog_merge_prune(spark, sf):
    return catalog.pruned(_paths(spark, sf)).select("doc_id", F.array_join("key", " > ").alias("key"), "name", "ord", F.col("depth").cast("long").alias("depth"))


@query(_TREE + ", l as (select doc_id, key, concat(repeat('  ', cast(len(key) - 1 as bigint)), '- ', name) as line from tree) select doc_id, md5(concat('# Catalog tài liệu: ', cast(doc_id as varchar), chr(10), string_agg(line, chr(10) order by key))) as outline_md5 from l group by doc_id", "paths")
def catalog_outline(spark, sf):
    tree = catalog.pruned(_paths(spark, sf))
    titles = tree.select("doc_id", F.col("doc_id").cast("string").alias("title")).distinct()
    return catalog.outline(tree, titles).select("doc_id", F.md5("outline").alias("outline_md5"))


_NUM = r"\d{1,4}/\d{4}/(?:NĐ-CP|TT-NHNN|QĐ-DDB)"


def _verbs_sql() -> str:
    parts = []
    for i, (name, verb) in enumerate(citations.VERBS):
        verb = verb.replace(r"|(?<!thay\s)\bthay\s+cho\b", "")  # the texts don't have that form
        parts.append(f"(case when regexp_matches(before, '(?is)(?:{verb})') then {{'far': length(before) - length(regexp_extract(before, '(?is)^(.*(?:{verb}))', 1)), 'turn': {2 * i}, 'type': '{name}'}} end)")
        parts.append(f"(case when regexp_matches(after, '(?is)(?:{verb})') then {{'far': length(regexp_extract(after, '(?is)^(.*?)(?:{verb})', 1)), 'turn': {2 * i + 1}, 'type': '{name}'}} end)")
    return "list_sort(list_filter([" + ", ".join(parts) + "], lambda s: s is not null))[1].type"


_CITE = rf"""with f as (select id, text, regexp_extract_all(text, '{_NUM}') as nums, regexp_split_to_array(text, '{_NUM}') as parts from citing),
e as (select id, text, nums, parts, unnest(generate_series(1, len(nums))) as i from f where len(nums) > 0),
x as (select id, i as pos, nums[i] as target, right(array_to_string(list_transform(generate_series(1, i), lambda j: case when j = 1 then parts[j] else concat(nums[j - 1], parts[j]) end), ''), 150) as before,
  left(array_to_string(list_transform(generate_series(i + 1, len(parts)), lambda j: case when j = i + 1 then parts[j] else concat(nums[j - 1], parts[j]) end), ''), 300) as after from e),
t as (select *, {_verbs_sql()} as type from x),
c as (select id as doc_id, pos, target, type, type = 'THAY_THE' and regexp_matches(after, '(?is){citations.PARTIAL}') as partial,
  case when type = 'THAY_THE' and regexp_matches(after, '(?is){citations.PARTIAL}') then nullif(trim(regexp_extract(after, '(?i){citations.SCOPE}')), '') end as scope,
  concat('...', right(trim(before), 60), ' [', target, '] ', left(trim(after), 80), '...') as evidence from t where type is not null)"""


def _citations(spark, sf):
    """The derived texts come from one small file; they are dealt out before the work on them."""
    texts = table(spark, sf, "citing")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return citations.extract(texts.repartition(parts, "id"), "id")


@query(_CITE + " select doc_id, cast(pos as bigint) as pos, target, type, partial, scope, evidence from c", "citing")
def citation_extract(spark, sf):
    return _citations(spark, sf).withColumn("pos", F.col("pos").cast("long"))


@query(_CITE + """, r as (select *, case when lag(type) over w is not distinct from type then null else pos end as changed from c window w as (partition by doc_id, target order by pos)),
l as (select doc_id, target, max(changed) as pos, count(*) as citations from r group by all)
select c.doc_id, c.target, c.type, c.partial, c.scope, cast(c.pos as bigint) as pos, l.citations from c join l using (doc_id, target, pos)""", "citing")
def citation_edge_last_wins(spark, sf):
    return citations.last_wins(_citations(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(_CITE + " select type, partial, count(*) as n from c group by all", "citing")
def citation_counts(spark, sf):
    return _citations(spark, sf).groupBy("type", "partial").agg(F.count("*").alias("n"))


def _graph(spark, sf):
    return table(spark, sf, "vertices"), table(spark, sf, "edges")


_DEGREE = "deg as (select id, count(*) as degree from (select src as id from edges union all select dst from edges) x group by id)"
_MAP = f"""{_DEGREE}, cand as (select v.*, coalesce(degree, 0) as degree from vertices v left join deg on id = entity_id where number is not null),
best as (select *, first_value(entity_id) over (partition by number order by degree desc, length(description) desc, entity_id) as new from cand), mapping as (select entity_id as old, new from best where entity_id <> new)"""


@query(f"with {_MAP} select old, new from mapping", "vertices edges")
def vanban_resolve(spark, sf):
    v, e = _graph(spark, sf)
    return graph.canonical(v, e, "number")


@query(f"""with {_MAP}, m as (select coalesce(a.new, src) as src, coalesce(b.new, dst) as dst, relation from edges left join mapping a on a.old = src left join mapping b on b.old = dst)
select src, dst, min(relation) filter (relation is not null) as least_relation, count(*) filter (relation is null) > 0 as has_null from m where src <> dst group by all""", "vertices edges")
def node_merge_relabel(spark, sf):
    v, e = _graph(spark, sf)
    m = graph.canonical(v, e, "number")
    e = e.join(m.select(F.col("old").alias("src"), F.col("new").alias("s")), "src", "left").join(m.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst", "left")
    e = e.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "relation").where("src <> dst")
    return e.groupBy("src", "dst").agg(F.min("relation").alias("least_relation"), (F.count_if(F.col("relation").isNull()) > 0).alias("has_null"))


@query(f"""with {_MAP}, m as (select coalesce(a.new, src) as src, coalesce(b.new, dst) as dst, relation from edges left join mapping a on a.old = src left join mapping b on b.old = dst)
select src, dst, relation from m where src <> dst qualify row_number() over (partition by src, dst order by relation nulls first) = 1""", "vertices edges")
def node_merge_edges(spark, sf):
    v, e = _graph(spark, sf)
    return graph.merged(e, graph.canonical(v, e, "number")).select("src", "dst", "relation")


@query("""with w as materialized (select *, case when src < 'd5' then 'x' end as loai, partial::int + (scope is not null)::int + (src < 'd5')::int as weight from edges),
r as materialized (select dst as src, src as dst, relation, max(weight) as other from w where relation is not null group by all)
select w.src, w.dst, w.relation, w.partial, w.scope, w.loai from w left join r on w.src = r.src and w.dst = r.dst and w.relation = r.relation
where other is null or weight > other or (weight = other and w.src < w.dst)""", "edges")
def parallel_edge_dedupe(spark, sf):
    return graph.dedupe_parallel(_graph(spark, sf)[1].withColumn("loai", F.when(F.col("src") < "d5", "x")))


_CITED = "cited as (select distinct src, dst, relation, partial, scope from edges where relation in ('CAN_CU', 'THAY_THE', 'THAM_CHIEU', 'UU_TIEN_HON')), starts as (select entity_id as id from vertices where number = 5), h1 as (select * from cited where src in (select id from starts) or dst in (select id from starts))"


@query(f"with {_CITED} select * from h1", "vertices edges")
def citation_neighbors_h1(spark, sf):
    v, e = _graph(spark, sf)
    return graph.neighbours(e, v.where("number = 5").select(F.col("entity_id").alias("id")), 1)


@query(f"with {_CITED}, s2 as (select src as id from h1 union select dst from h1) select distinct * from (select * from h1 union all select * from cited where src in (select id from s2) or dst in (select id from s2)) x", "vertices edges")
def citation_neighbors_h2(spark, sf):
    v, e = _graph(spark, sf)
    return graph.neighbours(e, v.where("number = 5").select(F.col("entity_id").alias("id")), 2)


@query("select k.entity_id as concept, a.src as value, d.src as document from vertices k left join edges a on a.dst = k.entity_id and a.relation = 'AP_DUNG_CHO' left join edges d on d.dst = a.src and d.relation = 'QUY_DINH' where k.entity_type = 'KhaiNiem'", "vertices edges")
def concept_bundle(spark, sf):
    v, e = _graph(spark, sf)
    return graph.concept_bundle(e, v.where("entity_type = 'KhaiNiem'").select(F.col("entity_id").alias("id")))


_WORDS = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda w: length(w) >= 2))"


@query(f"""with v as (select p_partkey as id, unnest({_WORDS.format('p_name')}) as word from part), c0 as (select p_partkey as concept, {_WORDS.format('p_type')} as w from part where p_partkey in (select min(p_partkey) from part group by p_type)),
c as (select concept, len(w) as size, unnest(w) as word from c0), h as (select id, concept, size, count(*) as overlap from v join c using (word) group by all)
select id, concept, overlap from h where overlap / size >= 0.5 qualify row_number() over (partition by id order by overlap desc, concept) = 1""")
def concept_link_overlap(spark, sf):
    p = table(spark, sf, "part")
    concepts = p.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    return graph.link_by_words(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), concepts)


_REASONS = """with k as (select entity_id, case when entity_type in ('VanBan', 'GiaTriQuyDinh', 'KhaiNiem') then entity_type end as type from vertices),
r as (select e.src, e.dst, e.relation, case when a.type is null or b.type is null then 'bad_type' when e.relation is null then 'unclassified'
  when concat(a.type, '>', e.relation, '>', b.type) in (select t from ok) or concat(b.type, '>', e.relation, '>', a.type) in (select t from ok) then null else 'invalid_triple' end as reason from edges e left join k a on a.entity_id = e.src left join k b on b.entity_id = e.dst)""".replace("(select t from ok)", "(" + ", ".join(f"'{a}>{r}>{b}'" for a, r, b in graph.TRIPLES) + ")")


@query(_REASONS + " select coalesce(reason, 'kept') as reason, count(*) as n, count(distinct src) as sources from r group by all", "vertices edges")
def ontology_filter_stats(spark, sf):
    r = graph.checked(*_graph(spark, sf))
    return r.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query(_REASONS + " select entity_id, entity_type from vertices where entity_id not in (select src from r where reason is null union select dst from r where reason is null)", "vertices edges")
def isolated_nodes(spark, sf):
    v, e = _graph(spark, sf)
    return graph.isolated(v, graph.checked(v, e).where("reason is null")).select("entity_id", "entity_type")


@query("select 'node' as kind, entity_type as type, count(*) as n from vertices where entity_type is not null group by all union all select 'edge', relation, count(*) from edges where relation is not null group by all", "vertices edges")
def graph_stats(spark, sf):
    return graph.stats(*_graph(spark, sf))


_CHAIN = """with t as (select v.id, coalesce(v.effective_date, v.created_at) as moment, v.owner, v.created_at,
  sum(case when v.supersedes_id is null then 1 else 0 end) over (partition by v.owner order by v.created_at, v.id) as run from versions v)"""


@query(_CHAIN + " select id, min(id) over (partition by owner, run) as chain, row_number() over (partition by owner, run order by moment, id) as version from t", "versions")
def version_chain(spark, sf):
    return lifecycle.version_chains(table(spark, sf, "versions")).withColumn("version", F.col("version").cast("long"))


_ACT = "act as (select id as new, supersedes_id as old, created_at as effective_date from versions where supersedes_id is not null)"


@query(f"""with {_ACT} select v.id, case when o.old is not null then false when n.new is not null then true else v.is_active end as is_active, coalesce(v.effective_date, n.effective_date) as effective_date, o.effective_date as expiry_date, o.new as superseded_by_id,
case when coalesce(case when o.old is not null then false when n.new is not null then true else v.is_active end, true) then 'active' when o.new is not null then 'superseded' else 'expired' end as lifecycle
from versions v left join act o on o.old = v.id left join act n on n.new = v.id""", "versions")
def supersede_apply(spark, sf):
    d = table(spark, sf, "versions")
    actions = d.where("supersedes_id is not null").select(F.col("id").alias("new"), F.col("supersedes_id").alias("old"), F.col("created_at").alias("effective_date"))
    return lifecycle.supersede(d, actions).withColumn("lifecycle", lifecycle.lifecycle()).select("id", "is_active", "effective_date", "expiry_date", "superseded_by_id", "lifecycle")


@query("select owner, count(*) filter (is_active is distinct from false) as by_vector, count(*) filter (is_active) as by_keyword from versions group by owner", "versions")
def active_filter_nulls(spark, sf):
    d = table(spark, sf, "versions")
    a = lifecycle.searchable_vectors(d).groupBy("owner").agg(F.count("*").alias("by_vector"))
    b = lifecycle.searchable_keywords(d).groupBy("owner").agg(F.count("*").alias("by_keyword"))
    out = d.select("owner").distinct().join(a, "owner", "left").join(b, "owner", "left")
    return out.select("owner", F.coalesce("by_vector", F.lit(0)).alias("by_vector"), F.coalesce("by_keyword", F.lit(0)).alias("by_keyword"))


@query("select doc_id, lang, source, (select count(*) from documents) as total from documents order by n_chars desc, doc_id limit 20 offset 20")
def documents_page(spark, sf):
    d = table(spark, sf, "documents")
    return d.orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(20).select("doc_id", "lang", "source").join(d.agg(F.count("*").alias("total")), F.lit(True))


@query("select text as question, role as persona_name, max(conv_id * 1000 + turn) as batch, count(*) as copies from conversations group by all")
def dataset_upsert(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("text").alias("question"), F.col("role").alias("persona_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("batch"))
    n = c.groupBy("question", "persona_name").agg(F.count("*").alias("copies")).withColumnsRenamed({"question": "q", "persona_name": "p"})
    newest = evalkit.latest(c, ["question", "persona_name"], "batch")
    return newest.join(n, F.col("question").eqNullSafe(F.col("q")) & F.col("persona_name").eqNullSafe(F.col("p"))).select("question", "persona_name", "batch", "copies")


@query(f"""with h as (select conv_id, turn, sha1(unhex('{T.SAMPLE_NAMESPACE}') || encode(concat('[', to_json(text), ', ', to_json(role), ']'))) as h from conversations)
select conv_id, turn, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', case h[17] when '0' then '8' when '4' then '8' when '8' then '8' when 'c' then '8' when '1' then '9' when '5' then '9' when '9' then '9' when 'd' then '9' when '2' then 'a' when '6' then 'a' when 'a' then 'a' when 'e' then 'a' else 'b' end, h[18:20], '-', h[21:32]) as sample_id from h""")
def sample_id_uuid5(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.sample_id(F.col("text"), F.col("role")).alias("sample_id"))


_SCORES = "s as (select d.lang as synthesizer, case when d.source = 'src7' then null else d.source end as persona, m as metric, case when l.doc_id % 10 = 3 then 'nan'::double when l.doc_id % 10 = 7 then null when m = 'quality' then l.quality::double else l.toxic::double end as value from labels l join documents d using (doc_id), (values ('quality'), ('toxic')) t(m))"


@query(f"with {_SCORES}, g as (select 'synthesizer' as slice, synthesizer as name, metric, value from s union all select 'persona', persona, metric, value from s) select slice, name, metric, round(avg(value), 6) as mean from g where name is not null and value is not null and not isnan(value) group by all")
def eval_breakdown(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    value = lambda c: F.when(F.col("doc_id") % 10 == 3, F.lit(float("nan"))).when(F.col("doc_id") % 10 == 7, None).otherwise(F.col(c).cast("double"))
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), value(c).alias("value")) for c in ("quality", "toxic")]))
    s = j.select(F.col("lang").alias("synthesizer"), F.when(F.col("source") != "src7", F.col("source")).alias("persona"), m.alias("m")).select("synthesizer", "persona", "m.*")
    return evalkit.breakdown(s).withColumn("mean", F.round("mean", 6))


@query("select o_custkey as set_id, cast(o_orderkey as varchar) as persona, cast(sum(cast(floor(o_totalprice) as bigint) % 50) over w // count(*) over w + (case when row_number() over (partition by o_custkey order by cast(o_orderkey as varchar)) <= sum(cast(floor(o_totalprice) as bigint) % 50) over w % count(*) over w then 1 else 0 end) as bigint) as samples from orders window w as (partition by o_custkey)")
def persona_batches(spark, sf):
    o = table(spark, sf, "orders")
    total = F.sum(F.floor("o_totalprice") % 50).over(Window.partitionBy("o_custkey"))
    return evalkit.persona_batches(o.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").cast("string").alias("persona"), total.alias("total")), "total")


_WEIGHTS = "w as (select source as name, count(*) / (select count(*) from documents)::double as weight, count(*) filter (lang <> 'en' and n_chars > 60000) as clusters, source >= 'src5' as multi from documents group by source)"


@query(f"with {_WEIGHTS} select name, round(case when multi and clusters = 0 then 0 when name = (select min(name) from w where not multi) then weight + (select coalesce(sum(weight), 0) from w where multi and clusters = 0) else weight end, 6) as weight, round(case when multi and clusters = 0 then weight else 0 end, 6) as moved from w")
def weight_backfill(spark, sf):
    d = table(spark, sf, "documents")
    n = d.count()
    w = d.groupBy(F.col("source").alias("name")).agg((F.count("*") / F.lit(float(n))).alias("weight"), F.count_if((F.col("lang") != "en") & (F.col("n_chars") > 60000)).alias("clusters")).withColumn("multi", F.col("name") >= "src5")
    return evalkit.backfill(w).select("name", F.round("weight", 6).alias("weight"), F.round("moved", 6).alias("moved"))


@query("""with e as (select distinct l_orderkey as id, l_partkey as chunk from lineitem), r as (select id as source, supersedes_id as target, case when id % 2 = 0 then 'extends' else 'replaces' end as type from versions where supersedes_id is not null)
select distinct a.chunk as src, b.chunk as dst, r.type as relation from r join e a on a.id = r.source join e b on b.id = r.target where a.chunk <> b.chunk""", "versions")
def contract_relations(spark, sf):
    """Orders stand for entities and their parts for chunks, so that an entity has a few chunks at any scale."""
    li, v = table(spark, sf, "lineitem"), table(spark, sf, "versions")
    entities = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("chunk_ids"))
    relations = v.where("supersedes_id is not null").select(F.col("id").alias("source"), F.col("supersedes_id").alias("target"), F.when(F.col("id") % 2 == 0, "extends").otherwise("replaces").alias("type"))
    return evalkit.contract_edges(entities, relations, table(spark, sf, "part").select(F.col("p_partkey").alias("id")))


_RUNS = "r as (select user_id as run_id, event_id, (event_id * 7 + user_id) % 1000 as seq, event_type as stage, value from events)"


@query(f"with {_RUNS}, m as (select *, max(seq) over (partition by run_id order by event_id rows between unbounded preceding and 1 preceding) as most from r) select run_id, seq, stage from m where most is null or seq > most")
def progress_dedupe(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", ((F.col("event_id") * 7 + F.col("user_id")) % 1000).alias("seq"), F.col("event_type").alias("stage"))
    return progress.in_order(e, "event_id").select("run_id", "seq", "stage")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def event_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.windows(e).withColumn("total", F.round("total", 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with a as (select conv_id, bool_or(role = 'user' and turn % 2 = 1) as approved, arg_min(text, turn) filter (role = 'user') as human, arg_min(text, turn) as first, arg_min(text, turn) filter (turn = 0) as question from conversations group by conv_id)
select conv_id as trace_id, coalesce(human, first) as expected from a where approved""")
def promote_human_preferred(spark, sf):
    c = table(spark, sf, "conversations")
    a = F.struct("turn", F.lit("expected_response").alias("name"), F.col("text").alias("value"), F.when(F.col("role") == "user", "HUMAN").otherwise("LLM").alias("source_type"))
    mark = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 1), F.struct(F.lit(-1).cast("bigint").alias("turn"), F.lit("approve").alias("name"), F.lit("pass").alias("value"), F.lit("HUMAN").alias("source_type")))
    t = c.groupBy(F.col("conv_id").alias("trace_id")).agg(F.array_sort(F.concat(F.collect_list(a), F.collect_set(mark))).alias("assessments"), F.min_by("text", "turn").alias("question"))
    return evalkit.promoted(t).select("trace_id", "expected")


@query(r"""select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'))) as text_md5 from pages""")
def html_pages_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(io.page_text(F.col("html"))).alias("text_md5"))


@query("select conv_id as document_id, array_to_string(list(trim(text) order by turn) filter (trim(text) <> ''), chr(10) || chr(10)) as text, count(*) filter (role = 'assistant' and turn % 3 = 1) as n_fallback from conversations group by conv_id")
def page_join(spark, sf):
    c = table(spark, sf, "conversations")
    parsed = F.when(~((F.col("role") == "assistant") & (F.col("turn") % 3 == 1)), F.col("text"))
    pages = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), parsed.alias("parsed"), F.col("text").alias("text_layer"))
    return io.joined_pages(io.parsed_pages(pages)).select("document_id", "text", "n_fallback")


@query("""with v as (select *, right(entity_id, 2) as file_path from vertices), own as (select file_path, min(entity_id) as src from v where entity_type = 'VanBan' group by file_path)
select own.src, v.entity_id as dst from v join own using (file_path) where v.entity_type in ('GiaTriQuyDinh', 'KhaiNiem') and not exists (select 1 from edges e where e.src = own.src and e.dst = v.entity_id)""", "vertices edges")
def provenance_link(spark, sf):
    v, e = _graph(spark, sf)
    return graph.provenance(v.withColumn("file_path", F.right("entity_id", F.lit(2))), e)


@query("with n as (select distinct concat('d', cast(s_suppkey as varchar)) as number from supplier) select n.number, min(entity_id) as entity_id from n join vertices v on contains(v.entity_id, n.number) group by n.number", "vertices")
def contains_lookup(spark, sf):
    v, _ = _graph(spark, sf)
    n = table(spark, sf, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("number"))
    return graph.contains_lookup(n, v)


@query("select lower(p_brand) as src, lower(trim(p_container)) as dst, relation, sum(weight)::double as weight from (select p_brand, upper(p_type) as p_container, 'AP_DUNG_CHO' as relation, p_size as weight from part) x group by all")
def canonical_weights(spark, sf):
    p = table(spark, sf, "part")
    e = p.select(F.col("p_brand").alias("src"), F.upper("p_type").alias("dst"), F.lit("AP_DUNG_CHO").alias("relation"), F.col("p_size").cast("double").alias("weight"))
    v = p.select(F.col("p_brand").alias("entity_id"), F.col("p_name").alias("description"))
    return graph.canonicalized(v, e)[1]


@query("with h as (select o_custkey as question_id, l_orderkey * 10 + l_linenumber as arrival, l_suppkey as chunk_id, l_discount * 100 + l_tax as score from lineitem join orders on o_orderkey = l_orderkey), f as (select * from h qualify row_number() over (partition by question_id, chunk_id order by arrival, score desc) = 1) select question_id, arrival, chunk_id, round(score, 4) as score, row_number() over (partition by question_id order by score desc, arrival, chunk_id) as rank from f qualify rank <= 5")
def rerank_hits(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    h = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("question_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"), F.col("l_suppkey").alias("chunk_id"), (F.col("l_discount") * 100 + F.col("l_tax")).alias("score"))
    return vectors.rerank(h, 5).select("question_id", "arrival", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("select cast(s_suppkey as varchar) as item, 'missing type' as error from supplier where s_suppkey % 7 = 0 union all select cast(c_nationkey as varchar), 'dangling source' from customer where c_nationkey not in (select s_suppkey from supplier) union all select cast(c_custkey as varchar), 'dangling target' from customer where c_custkey not in (select s_suppkey from supplier)")
def contract_errors(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    entities = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 7 != 0, "KhaiNiem").alias("type"))
    return evalkit.contract_errors(entities, c.select(F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("target")))


@query("select doc_id as sample_id, 'm' as metric, avg(quality::double) as a, avg(toxic::double) as b, avg(toxic::double) - avg(quality::double) as gain from labels group by doc_id")
def run_compare(spark, sf):
    r = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.lit("m").alias("metric"), F.explode(F.array(F.struct(F.lit("a").alias("technique"), F.col("quality").cast("double").alias("value")), F.struct(F.lit("b").alias("technique"), F.col("toxic").cast("double").alias("value")))).alias("x"))
    return evalkit.compared(r.select("sample_id", "metric", "x.*"))


@query(rf"with b as (select doc_id, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+')) as c, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')) as r from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)) select doc_id as sample_id, round(len(list_intersect(c, r)) / greatest(len(c), 1), 6) as precision, round(len(list_intersect(c, r)) / greatest(len(r), 1), 6) as recall from b")
def token_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select((F.col("item_id")).alias("k"), F.col("text").alias("reference"))
    n = b.count()
    a = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % n).join(b, "k").select(F.col("doc_id").alias("sample_id"), F.array("text").alias("contexts"), "reference")
    return evalkit.token_overlap(a).select("sample_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("select l.lang, l.source, count(*) as documents, count(*) filter (n_chars > 2000) as long_documents, sum(n_chars)::bigint as chars, max(n_chars) as longest from documents l group by all")
def catalog_listing(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") > 2000).alias("long_documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
