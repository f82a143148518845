"""Further queries over the given tables: graph search, resolution, prompts, lifecycle, evaluation, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweir.functions import text as T
from docweir.operators import catalog, evalkit, graph, graphsearch, lifecycle, prompts, resolution, vectors
from docweir.sources import io

from .queries import _CHAIN, _graph, query
from .tables import table

_NORM = "sqrt(list_inner_product({0}, {0}))"


@query("""with q as (select vec_id as query_id, case when label % 2 = 0 then concat('c', vec_id) else 'zzz' end as text, embedding::double[] as e from embeddings where vec_id % 50 = 0),
c as (select concat('c', vec_id) as name, embedding::double[] as e from embeddings),
w as (select query_id, name, 1.0::double as score from q join c on q.text = c.name),
v as (select query_id, name, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e)) + 1e-9) as score from q join c on q.text = 'zzz'),
u as (select * from w union all select * from v where score >= 0.25)
select query_id, name, round(score, 6) as score, row_number() over (partition by query_id order by score desc, name desc) as rank from u qualify rank <= 5""")
def concept_match(spark, sf):
    """Queries name a concept, or are matched by their vectors."""
    v = table(spark, sf, "embeddings")
    concepts = v.select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("name"), "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("c"), F.col("vec_id").cast("string"))).otherwise("zzz").alias("text"), "embedding")
    return graphsearch.match_concepts(q, concepts, 5, cosine=0.25).select("query_id", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""with c as materialized (select distinct p_name as name, string_split(lower(p_name), ' ') as w from part), q as (select p_partkey as query_id, list_distinct(string_split(concat(lower(p_type), ' ', lower(p_name)), ' ')) as w from part),
s as (select query_id, name, len(list_intersect(q.w, list_distinct(c.w))) / len(list_distinct(c.w))::double as score from q, c)
select query_id, name, round(score, 6) as score, row_number() over (partition by query_id order by score desc, name desc) as rank from s where score >= 0.5 qualify rank <= 5""")
def concept_match_ratio(spark, sf):
    p = table(spark, sf, "part")
    none = F.lit(None).cast("array<float>")
    q = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_type", "p_name").alias("text"), none.alias("embedding"))
    c = p.select(F.col("p_name").alias("name"), none.alias("embedding")).distinct()
    return graphsearch.match_concepts(q, c).select("query_id", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FACTS = """with t as (select distinct l_partkey as query_id, concat('d', cast(l_suppkey as varchar)) as id from lineitem where l_partkey % 50 = 0),
ce as materialized (select distinct src, dst, relation from edges where relation in ('CAN_CU', 'THAY_THE', 'THAM_CHIEU', 'UU_TIEN_HON')),
vt as materialized (select entity_id, entity_type from vertices),
h as (select distinct query_id, src, dst, relation from (select query_id, src, dst, relation from ce join t on ce.src = t.id union all select query_id, src, dst, relation from ce join t on ce.dst = t.id) x join vt on vt.entity_id = x.src),
cf as (select query_id, 0 as turn, concat_ws('|', src, relation, dst) as fact_id, src, relation, dst from h qualify row_number() over (partition by query_id order by fact_id) <= 100),
m as (select p_partkey as query_id, concat('k', p_brand) as name from part where p_partkey % 50 = 0),
ap as materialized (select distinct src as value, dst as concept from edges where relation = 'AP_DUNG_CHO'),
qd as materialized (select distinct e.src as document, e.dst as value from edges e join vertices v on v.entity_id = e.src and v.entity_type = 'VanBan' where relation = 'QUY_DINH'),
b as (select query_id, concept, ap.value, document from m join ap on ap.concept = m.name left join qd on qd.value = ap.value qualify row_number() over (partition by query_id order by concept, ap.value, document nulls first) <= 200),
kf as (select distinct query_id, 1 as turn, concat_ws('|', value, 'AP_DUNG_CHO', concept) as fact_id, value as src, 'AP_DUNG_CHO' as relation, concept as dst from b
  union select distinct query_id, 1, concat_ws('|', document, 'QUY_DINH', value), document, 'QUY_DINH', value from b where document is not null),
f as (select * from cf union all select * from kf qualify row_number() over (partition by query_id, fact_id order by turn) = 1)"""


def _matched(spark, sf):
    p = table(spark, sf, "part").where("p_partkey % 50 = 0")
    return p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("k"), "p_brand").alias("name"))


@query(_FACTS + """ select query_id, fact_id, src as source_entity, coalesce(a.entity_type, '') as source_type, relation, dst as target_entity, coalesce(c.entity_type, '') as target_type,
  case when turn = 0 then 'citation_neighbor' else 'concept_traversal' end as strategy, row_number() over (partition by query_id order by turn, fact_id) as rank
from f left join vt a on a.entity_id = f.src left join vt c on c.entity_id = f.dst qualify rank <= 12""", "vertices edges")
def graph_facts(spark, sf):
    """Twelve facts a query, so that both strategies have room in some."""
    v, e = _graph(spark, sf)
    titles = table(spark, sf, "lineitem").where("l_partkey % 50 = 0").select(F.col("l_partkey").alias("query_id"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("title"))
    out = graphsearch.found_facts(v.withColumn("file_path", F.col("entity_id")), e, titles, _matched(spark, sf), cap=12)
    return out.select("query_id", "fact_id", "source_entity", "source_type", "relation", "target_entity", "target_type", "strategy", F.col("rank").cast("long").alias("rank"))


@query(_FACTS.replace("select * from cf union all select * from kf qualify", "select * from kf qualify") + " select query_id, count(*) as facts, count(*) filter (relation = 'QUY_DINH') as sets, min(fact_id) as first_fact from f group by query_id", "vertices edges")
def concept_fact_counts(spark, sf):
    k = graphsearch.concept_edges(*_graph(spark, sf), _matched(spark, sf))
    return k.groupBy("query_id").agg(F.count("*").alias("facts"), F.count_if(F.col("relation") == "QUY_DINH").alias("sets"), F.min("fact_id").alias("first_fact"))


@query("""with f as (select l_orderkey as question_id, l_linenumber as subgoal, concat_ws('|', l_suppkey % 3, l_returnflag) as fact_id, l_discount as score from lineitem),
o as (select * from f qualify row_number() over (partition by question_id, fact_id order by subgoal, score desc) = 1)
select question_id, subgoal, fact_id, round(score, 4) as score, row_number() over (partition by question_id order by o.score desc, subgoal, fact_id) as rank from o""")
def merged_facts(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("subgoal"), F.concat_ws("|", (F.col("l_suppkey") % 3).cast("string"), "l_returnflag").alias("fact_id"), F.col("l_discount").alias("score"))
    return graphsearch.merged_facts(f).select("question_id", "subgoal", "fact_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_TERMS = r"""terms as materialized (select term as entity_id, repeat('x', cast(count(distinct doc_id) % 9 as bigint)) as description from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents) x group by term),
keyed as materialized (select *, lower(strip_accents(translate(entity_id, 'đĐ', 'dD'))) as k from terms),
best as materialized (select *, first_value(entity_id) over (partition by k order by length(description) desc, entity_id) as new from keyed)"""


@query(f"with {_TERMS}, gone as (select new, string_agg(concat(' <MERGED_FROM> ', description), '' order by entity_id) as more, list(entity_id order by entity_id) as aliases from best where entity_id <> new group by new) select b.entity_id, concat(b.description, coalesce(more, '')) as description, array_to_string(coalesce(aliases, []), ',') as aliases from best b left join gone g on g.new = b.entity_id where b.entity_id = b.new")
def diacritics_merge(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("entity_id"))
    v = t.groupBy("entity_id").agg(F.repeat(F.lit("x"), (F.countDistinct("doc_id") % 9).cast("int")).alias("description")).withColumn("entity_type", F.lit("KhaiNiem"))
    m = resolution.diacritics_mapping(v, "KhaiNiem")
    return resolution.merged_vertices(v, m).select("entity_id", "description", F.array_join("aliases", ",").alias("aliases"))


@query(_CHAIN + """, n as (select owner, run, concat('o', cast(id as varchar)) as entity_id, id % 7 as size from t)
select entity_id as old, first_value(entity_id) over (partition by owner, run order by size desc, entity_id) as new from n qualify old <> new""", "versions")
def fuzzy_merge(spark, sf):
    """Confirmed pairs are an order and the one before it; their chains are merged whole."""
    d = table(spark, sf, "versions")
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    v = d.select(name("id").alias("entity_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("description"))
    return resolution.fuzzy_mapping(v, d.where("supersedes_id is not null").select(name("id").alias("a"), name("supersedes_id").alias("b")))


@query("""with v as (select p_partkey as id, lower(p_name) as name from part where concat('v', cast(p_partkey as varchar)) not in (select src from edges where relation = 'AP_DUNG_CHO')),
c as (select min(p_partkey) as concept, lower(p_type) as name from part group by p_type),
w as (select id, concept, 1.0::double as score from v join c on list_contains(string_split(v.name, ' '), c.name) qualify row_number() over (partition by id order by concept) = 1),
e as (select vec_id, embedding::double[] as e from embeddings),
s as (select v.id, c.concept, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)) + 1e-9) as score from v join e a on a.vec_id = v.id, c join e b on b.vec_id = c.concept where v.id not in (select id from w)),
n as (select * from s where score >= 0.05 qualify row_number() over (partition by id order by score desc, concept desc) = 1)
select id, concept, round(score, 6) as score, 'words' as via from w union all select id, concept, round(score, 6), 'embedding' from n""", "edges")
def concept_links(spark, sf):
    """Values without a concept: linked by words, else by vectors (0.05 or more, as those of the table are random)."""
    p, e = table(spark, sf, "part"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    v = p.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    v = resolution.without_link(v, _graph(spark, sf)[1]).join(e, "id", "left")
    c = p.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id")).join(e, "id", "left")
    return resolution.link_concepts(v, c.where("embedding is not null"), 0.05).select("id", "concept", F.round("score", 6).alias("score"), "via")


_OWN = "vb as materialized (select concat('Văn bản ', own) as entity_id, min(id) as id from citing where id % 3 <> 1 group by own), c as (select id, regexp_extract(text, '\\d{1,4}/\\d{4}/[^ .,;]+') as target from citing where regexp_matches(text, '\\d{1,4}/\\d{4}/')), own as (select id, entity_id as src from vb)"


@query(f"with {_OWN}, k as materialized (select target, min(entity_id) as known from (select distinct target from c) t join vb on contains(vb.entity_id, t.target) group by target) select c.id as title, own.src, coalesce(known, c.target) as dst, known is null as is_new from c join own using (id) left join k using (target) where not contains(own.src, c.target)", "citing")
def citation_targets(spark, sf):
    """Two thirds of the documents' numbers have a vertex; targets without one are new."""
    t = table(spark, sf, "citing")
    v = t.where("id % 3 <> 1").groupBy(F.concat(F.lit("Văn bản "), "own").alias("entity_id")).agg(F.min("id").cast("string").alias("file_path")).withColumn("entity_type", F.lit("VanBan"))
    c = t.select(F.col("id").cast("string").alias("title"), F.regexp_extract("text", r"\d{1,4}/\d{4}/[^ .,;]+", 0).alias("target"), F.lit("CAN_CU").alias("type")).where("target <> ''")
    edges, new = resolution.citation_targets(c, v)
    out = edges.join(new.select(F.col("entity_id").alias("dst"), F.lit(True).alias("is_new")), "dst", "left")
    return out.select(F.col("title").cast("long").alias("title"), "src", "dst", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query("""with r as (select p_partkey // 40 as doc_id, p_brand, p_name, p_type from part), n as (select doc_id, p_brand as name from r union select doc_id, p_name from r union select doc_id, p_type from r) select doc_id, name from n""")
def catalog_json_names(spark, sf):
    """Names of trees in JSON: objects, headings, bare strings, blank ones and one that is no JSON."""
    p = table(spark, sf, "part")
    tree = F.concat(F.lit('{"tree":[{"name":" '), "p_brand", F.lit('","children":["'), "p_name", F.lit('",{"entity":"'), "p_type", F.lit('","headings":[" ",""]},{"children":["lost"]},7]}]}'))
    a = p.select(F.expr("p_partkey div 40").alias("doc_id"), F.col("p_partkey").alias("unit"), tree.alias("answer"))
    bad = p.select(F.expr("p_partkey div 40").alias("doc_id"), F.col("p_partkey").alias("unit"), F.lit("{no json").alias("answer"))
    return catalog.names(catalog.normalized(a.union(bad)))


@query("select c.conv_id as doc_id, md5(string_agg(distinct lower(trim(split_part(c.text, '.', 1))), '|' order by lower(trim(split_part(c.text, '.', 1))))) as names_md5 from conversations c where trim(split_part(c.text, '.', 1)) <> '' and regexp_matches(c.text, '^[A-Za-zÀ-ỹ ]+\\.') and length(trim(split_part(c.text, '.', 1))) <= 120 group by c.conv_id")
def catalog_generated(spark, sf):
    """A stand-in for a model names a unit by its first sentence, below a heading; pruned catalogs."""
    c = table(spark, sf, "conversations")
    first = T.strip(F.split_part("text", F.lit("."), F.lit(1)))
    units = c.where(F.col("text").rlike(r"^[A-Za-zÀ-ỹ ]+\.")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit"), first.alias("text"))
    answer = lambda t: F.to_json(F.array(F.struct(F.lit("Unit").alias("name"), F.array(t).alias("children"))))
    tree = catalog.generated(units, answer).where("depth = 2")
    return tree.groupBy("doc_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.element_at("key", 2))), "|")).alias("names_md5"))


@query("select p_partkey as id, array_to_string(case when p_size % 3 = 0 then [p_name, p_type] when p_brand = 'Brand#1' then ['term', 'date'] else ['name'] end, ';') as focus, case when p_type in ('ECONOMY', 'SMALL') then p_type end as entity_type from part")
def focus_entities(spark, sf):
    p = table(spark, sf, "part")
    custom = T.focus_entities(F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("; "), "p_type", F.lit(", \n"))).otherwise(" ;"))
    focus = catalog.focus(F.col("p_brand"), custom, {"Brand#1": ["term", "date"], "other": ["name"]}, "other")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(focus, ";").alias("focus"), resolution.entity_type(F.concat(F.lit(" "), F.lower("p_type")), ["ECONOMY", "SMALL"]).alias("entity_type"))


_LINES = "li as (select l_orderkey as question_id, l_linenumber::bigint * 1000000000000000000 + l_partkey::bigint * 1000000000 + l_suppkey as rank, concat('Part ', cast(l_partkey as varchar)) as title, l_suppkey as chunk_index, concat('content ', l_returnflag) as content, l_partkey as doc_id from lineitem)"


@query(f"with {_LINES}, b as (select *, row_number() over (partition by question_id order by rank) as n from li) select question_id, md5(string_agg(concat('[', n, '] (Tài liệu: ', title, ', đoạn #', chunk_index, ')', chr(10), content), chr(10) || chr(10) order by n)) as context_md5 from b group by question_id")
def context_blocks(spark, sf):
    return prompts.context(_cited(spark, sf)).select("question_id", F.md5("context").alias("context_md5"))


def _cited(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("question_id"), (F.col("l_linenumber").cast("long") * 10**18 + F.col("l_partkey").cast("long") * 10**9 + F.col("l_suppkey")).alias("rank"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"), F.col("l_suppkey").alias("chunk_index"), F.concat(F.lit("content "), "l_returnflag").alias("content"), F.col("l_partkey").alias("doc_id"))


@query(f"""with {_LINES}, b as (select *, row_number() over (partition by question_id order by rank) as n from li), c as (select question_id, string_agg(concat('[', n, '] (Tài liệu: ', title, ', đoạn #', chunk_index, ')', chr(10), content), chr(10) || chr(10) order by n) as context from b group by question_id),
g as (select question_id, string_agg(concat('- goal ', rank, ': ', case when rank % 2 = 0 then 'chưa đủ bằng chứng' else 'more' end), chr(10) order by rank) as missing from li where rank >= 3000000000000000000 group by question_id)
select o_orderkey as question_id, md5(concat('NGỮ CẢNH:', chr(10), coalesce(context, '(không có ngữ cảnh)'), case when o_orderkey % 3 = 0 then concat(chr(10), chr(10), 'CATALOG:', chr(10), '# ', o_orderstatus) else '' end,
  case when f.lines is null then '' else concat(chr(10), chr(10), 'TRI THỨC ĐỒ THỊ (quan hệ giữa văn bản/khái niệm — KHÔNG phải trích dẫn nguyên văn):', chr(10), f.lines) end,
  case when missing is null then '' else concat(chr(10), chr(10), 'PHẦN CÒN THIẾU BẰNG CHỨNG (nêu rõ trong câu trả lời, KHÔNG bịa):', chr(10), missing) end, chr(10), chr(10), 'CÂU HỎI: ', o_orderpriority)) as prompt_md5
from orders left join c on c.question_id = o_orderkey left join g on g.question_id = o_orderkey
left join (select l_orderkey as question_id, string_agg(concat('- p', l_partkey, ' --QUY_DINH--> s', l_suppkey, case when l_linenumber = 1 then concat(' ({{"flag":"', l_returnflag, '"}})') else '' end, case when l_linenumber = 2 then '' else concat(' [nguồn: t', l_linenumber, ']') end), chr(10) order by l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey) as lines from lineitem where l_returnflag = 'R' group by l_orderkey) f on f.question_id = o_orderkey""")
def advanced_prompts(spark, sf):
    cited = _cited(spark, sf)
    goals = cited.select("question_id", F.col("rank").alias("subgoal"), F.concat(F.lit("goal "), F.col("rank").cast("string")).alias("description"), (F.col("rank") < 3 * 10**18).alias("satisfied"), F.when(F.col("rank") % 2 == 0, "").otherwise("more").alias("note"))
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    q = o.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("text"))
    said = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    props = F.map_filter(F.create_map(F.lit("flag"), "l_returnflag"), lambda k, v: F.col("l_linenumber") == 1)
    line = prompts.fact_line(said("p", "l_partkey"), F.lit("QUY_DINH"), said("s", "l_suppkey"), props, F.when(F.col("l_linenumber") == 2, "").otherwise(said("t", "l_linenumber")))
    facts = li.select(F.col("l_orderkey").alias("question_id"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("rank"), line.alias("line"))
    outlines = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("question_id"), said("# ", "o_orderstatus").alias("outline"))
    return prompts.prompt(q, prompts.context(cited), goals, facts, outlines).select("question_id", F.md5("prompt").alias("prompt_md5"))


@query(f"with {_LINES}, f as (select question_id, doc_id, min(rank) as first from li group by all) select question_id, doc_id, row_number() over (partition by question_id order by first, doc_id) as rank from f join part on p_partkey = doc_id where p_size % 5 <> 0")
def hit_documents(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 7 == 0, None).otherwise(True).alias("is_active"), "p_size")
    d = d.withColumn("is_active", F.when(F.col("p_size") % 5 == 0, False).otherwise(F.col("is_active"))).drop("p_size")
    return prompts.hit_documents(prompts.hit_records(_cited(spark, sf)), d).select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""select o_orderkey as goal_id, case when o_orderkey % 3 = 0 then o_orderkey % 2 = 0 else exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') end as satisfied,
case when o_orderkey % 3 = 0 then 'note' when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then '' else 'Không có bằng chứng.' end as note from orders""")
def goal_verdicts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("goal_id"))
    r = o.where("goal_id % 3 = 0").select("goal_id", (F.col("goal_id") % 2 == 0).alias("satisfied"), F.lit(" note ").alias("note"))
    return prompts.verdicts(o, r, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("goal_id")))


@query("select o_orderkey as call_id, o_orderpriority as tool, o_orderstatus as args, cast(case when o_orderkey % 5 = 0 then 0 else count(*) end as bigint) as hit_count from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderpriority, o_orderstatus")
def tool_trace(spark, sf):
    calls = table(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("args"))
    hits = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.to_json(F.collect_list("l_partkey")).alias("content"))
    hits = hits.withColumn("content", F.when(F.col("call_id") % 5 == 0, '{"error": 1').otherwise(F.col("content")))
    return prompts.tool_trace(calls, hits).withColumn("hit_count", F.col("hit_count").cast("long"))


_STATUS = "case when value > 30 then 'failed' when value > 5 then 'completed' else 'started' end"


@query(f"with e as (select user_id as run_id, event_id as seq, event_type as label, {_STATUS} as status, user_id % 3 = 0 as active from events) select run_id, count(*) filter (status = 'completed') as completed, arg_max(label, seq) as latest, arg_max(label, seq) filter (status = 'failed') as last_failed, not bool_or(active) and not bool_or(status = 'failed') and bool_or(status = 'started') as interrupted from e group by run_id")
def run_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("label"), F.expr(_STATUS).alias("status"), (F.col("user_id") % 3 == 0).alias("active"))
    return prompts.run_summary(e)


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events where try_cast(json_extract_string(props, '$.k') as int) = 69")
def version_gate(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    bad = e.select((-F.col("event_id")).alias("event_id"), F.lit("[oops").alias("props"))
    return io.gated(e.union(bad), "props", 69, "k").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""select id, case when id % 11 = 0 then false else is_active end as is_active, case when id % 11 = 0 then created_at end as expiry_date, case when id % 4 = 0 then 'failed' else 'done' end as graph_status from versions""", "versions")
def expire_recover(spark, sf):
    d = table(spark, sf, "versions").withColumn("graph_status", F.when(F.col("id") % 4 == 0, "building").otherwise("done"))
    acts = d.where("id % 11 = 0").select("id", F.col("created_at").alias("effective_date"))
    return lifecycle.recovered(lifecycle.expire(d, acts)).select("id", "is_active", "expiry_date", "graph_status")


@query("""select v.id, coalesce(v.is_active, true) or v.id % 13 = 0 as is_active, case when v.id % 13 = 0 then null else n.id end as superseded_by_id, case when v.id % 13 = 0 or coalesce(v.is_active, true) then 'active' when n.id is not null then 'superseded' else 'expired' end as lifecycle
from versions v left join versions n on n.supersedes_id = v.id""", "versions")
def reactivated(spark, sf):
    d = table(spark, sf, "versions")
    by = d.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"), F.col("id").alias("by"))
    d = d.drop("superseded_by_id").join(by, "id", "left").withColumnRenamed("by", "superseded_by_id")
    out = lifecycle.reactivate(d, d.where("id % 13 = 0").select("id"))
    return out.select("id", F.coalesce("is_active", F.lit(True)).alias("is_active"), "superseded_by_id", lifecycle.lifecycle().alias("lifecycle"))


@query("""with gone as (select o_orderkey as id from orders where o_orderpriority = '5-LOW'), g2 as (select id from gone where id % 4 <> 0)
select 'lineitem' as name, count(*) as n, 'cascade' as step from lineitem where l_orderkey not in (select id from gone) union all select 'orders', count(*), 'cascade' from orders where o_orderkey not in (select id from gone)
union all select 'lineitem', count(*), 'reset' from lineitem where l_orderkey not in (select id from g2) union all select 'uploaded', (select count(*) from g2), 'reset'""")
def delete_cascade(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    docs = o.select(F.col("o_orderkey").alias("document_id"), "o_orderpriority", F.lit("indexed").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "building").alias("graph_status"))
    chunks, gone = li.select(F.col("l_orderkey").alias("document_id")), docs.where("o_orderpriority = '5-LOW'").select("document_id")
    left = lifecycle.without({"orders": docs, "lineitem": chunks}, gone)
    again, rest = lifecycle.reset(docs, {"lineitem": chunks}, gone)
    rows = [(left["lineitem"], "lineitem", "cascade"), (left["orders"], "orders", "cascade"), (rest["lineitem"], "lineitem", "reset"), (again.where("status = 'uploaded'"), "uploaded", "reset")]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(step).alias("step")) for df, name, step in rows]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("select entity_id, entity_type from vertices where entity_id not in (select entity_id from vertices where number = 3) order by 1", "vertices")
def graph_without_document(spark, sf):
    v, e = _graph(spark, sf)
    v = graph.stamped(v.withColumn("file_path", F.col("entity_id")).withColumn("document_id", F.lit(None).cast("string")), v.where("number is not null").select(F.col("number").cast("string").alias("document_id"), F.col("entity_id").alias("title")))
    left, _ = graph.without_document(v, e, spark.range(1).select(F.lit("3").alias("document_id")))
    return left.select("entity_id", "entity_type")


@query("select l_orderkey as document_id, count(*) as chunks from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' group by all")
def chunk_collection(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "indexed").otherwise("parsing").alias("status"))
    c = evalkit.collected(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index")), d)
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("""with e as (select distinct l_orderkey as id, l_partkey as chunk from lineitem), r as (select id as source, supersedes_id as target from versions where supersedes_id is not null)
select a.chunk as src, b.chunk as dst, concat('e', cast(r.source as varchar)) as source_name, concat('e', cast(r.target as varchar)) as target_name, true as bidirectional, 1.0::double as score from r join e a on a.id = r.source join e b on b.id = r.target where a.chunk <> b.chunk""", "versions")
def contract_links(spark, sf):
    e, r, chunks = _contract(spark, sf)
    return evalkit.contract_links(e, r, chunks).drop("kg_relation")


def _contract(spark, sf):
    li, v = table(spark, sf, "lineitem"), table(spark, sf, "versions")
    e = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("chunk_ids")).withColumn("name", F.concat(F.lit("e"), F.col("id").cast("string"))).withColumn("ord", F.col("id"))
    r = v.where("supersedes_id is not null").select(F.col("id").alias("source"), F.col("supersedes_id").alias("target"), F.lit("extends").alias("type"))
    return e, r, table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


@query("with e as (select distinct l_orderkey as id, l_partkey as chunk from lineitem) select chunk, md5(string_agg(concat('e', cast(id as varchar)), ',' order by id)) as names_md5, count(*) as n from e join part on p_partkey = chunk group by chunk")
def chunk_entities(spark, sf):
    e, _, chunks = _contract(spark, sf)
    return evalkit.chunk_entities(e, chunks).select("chunk", F.md5(F.array_join("names", ",")).alias("names_md5"), "n")


@query("select conv_id, turn, role as persona_name, text as question, case role when 'user' then 'single-hop' else 'multi-hop' end as hop_type, case when role = 'user' then 'single_hop_x' else 'multi_hop_y' end as synthesizer_name, 'llm' as generator from conversations")
def eval_records(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("text").alias("user_input"), F.col("role").alias("persona_name"), F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("reference"), F.lit(None).cast("array<string>").alias("reference_contexts"), F.when(F.col("role") == "user", "single_hop_x").otherwise("multi_hop_y").alias("synthesizer_name"))
    at = F.split("expectations.expected_response", ",")
    return evalkit.records(c).select(at[0].cast("long").alias("conv_id"), at[1].cast(table(spark, sf, "conversations").schema["turn"].dataType).alias("turn"), "inputs.persona_name", "inputs.question", "tags.hop_type", "tags.synthesizer_name", "source.source_data.generator")


@query("select doc_id as trace_id, case when doc_id % 2 = 0 then 's' end as synthesizer_name, 'p' as persona_name, quality::double as quality, case when toxic = 1 then 1.0 else 0.0 end::double as toxic from labels")
def trace_rows(spark, sf):
    m = table(spark, sf, "labels")
    said = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    a = F.array(said("quality", F.lit("0.25")), said("quality", F.lit("good")), said("quality", F.col("quality").cast("string")), said("toxic", F.when(F.col("toxic") == 1, "true").otherwise("false")), said("note", F.lit("text")))
    tags = F.map_filter(F.create_map(F.lit("synthesizer_name"), F.when(F.col("doc_id") % 2 == 0, "s"), F.lit("persona_name"), F.lit("p")), lambda _, v: v.isNotNull())
    return evalkit.rows_from_traces(m.select(F.col("doc_id").alias("trace_id"), tags.alias("tags"), a.alias("assessments")), ["quality", "toxic"])


@query("""with a as (select l_orderkey, case when l_orderkey % 2 = 0 then 'a' else 'b' end as technique, list_distinct(list(l_partkey)) as expected, list_distinct(list(l_partkey) filter (l_returnflag <> 'R')) as found, count(*) as claims, count(*) filter (l_returnflag <> 'R') as supported, bool_or(l_returnflag = 'A') as conflict, bool_or(l_linenumber = 4) as reported, max(l_linenumber) > 3 as current from lineitem group by l_orderkey)
select technique, round(avg(len(list_intersect(expected, coalesce(found, []))) / len(expected)), 6) as evidence_coverage, round(avg(current::int), 6) as current_version_accuracy, round(1 - sum(supported) / sum(claims), 6) as unsupported_conclusions, round(avg(reported::int) filter (conflict), 6) as conflict_detection from a group by technique""")
def evidence_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = F.col("l_returnflag") != "R"
    a = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("expected"), F.collect_set(F.when(kept, F.col("l_partkey"))).alias("found"), F.count("*").alias("claims"), F.count_if(kept).alias("supported"), F.bool_or(F.col("l_returnflag") == "A").alias("conflict"), F.bool_or(F.col("l_linenumber") == 4).alias("reported"), (F.max("l_linenumber") > 3).alias("current"))
    out = evalkit.evidence_metrics(a.withColumn("technique", F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b")))
    return out.select("technique", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("select l_orderkey as query_id, l_linenumber as doc_id, round((l_discount - 0.2) / coalesce(nullif(max(l_discount - 0.2) over (partition by l_orderkey), 0), 1), 6) as score from lineitem")
def fuse_negative_max(spark, sf):
    """Where the largest score is negative, dividing by it turns the order around."""
    h = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("doc_id"), (F.col("l_discount") - 0.2).alias("score"))
    return vectors.normalized(h).withColumn("score", F.round("score", 6))


@query("select owner, count(*) filter (is_active) as active, count(*) filter (not is_active) as archived, count(*) filter (is_active and id % 2 = 0 and supersedes_id is null) as replaceable, count(*) filter (id % 3 = 0) as eligible from versions group by owner", "versions")
def document_selections(spark, sf):
    d = table(spark, sf, "versions").withColumn("status", F.when(F.col("id") % 2 == 0, "indexed").otherwise("parsing")).withColumn("category", F.when(F.col("id") % 3 == 0, "law").otherwise("memo"))
    r, g = (f.groupBy("owner").agg(F.count("*").alias(n)) for f, n in ((lifecycle.replaceable(d), "replaceable"), (lifecycle.eligible(d, ["law"]), "eligible")))
    out = d.groupBy("owner").agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("archived")).join(r, "owner", "left").join(g, "owner", "left")
    return out.select("owner", "active", "archived", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("replaceable", "eligible")])


@query("select l_orderkey as document_id, count(*) as chunks from lineitem group by l_orderkey")
def chunk_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("chunks"))


_RELATION = "case " + " ".join(f"when {' or '.join(f'contains(lower(text), {chr(39)}{k}{chr(39)})' for k in ks)} then '{r}'" for r, ks in graph.KEYWORDS.items()) + " end"


@query(f"select id, {_RELATION} as relation, concat(replace(text, '{{', '('), ' [1](#citation-1) [2](u)') as answer from citing", "citing")
def relation_keywords(spark, sf):
    t = table(spark, sf, "citing")
    fenced = F.concat(F.lit("```json\n"), F.replace("text", F.lit("{"), F.lit("(")), F.lit(" [1] [2](u)\n```"))
    return t.select("id", graph.classify_relation(F.col("text")).alias("relation"), T.link_citations(T.strip_fence(fenced)).alias("answer"))


@query("""with n as (select p_partkey // 40 as doc_id, lower(concat(p_type, ' ', p_name)) as name from part where p_partkey % 3 = 0),
c as (select p_partkey as concept, unnest([p_partkey // 40, p_partkey // 40 + 2]) as doc_id, list_filter(list_distinct(string_split(lower(concat(p_name, ' ', p_type, ' ', p_brand)), ' ')), lambda w: length(w) >= 3) as w from part),
s as (select concept, doc_id, len(list_filter(w, lambda x: contains(blob, x))) / len(w)::double as share from c join (select doc_id, string_agg(name, ' | ') as blob from n group by doc_id) b using (doc_id))
select concept, doc_id, round(share, 6) as share from s where share >= 0.6""")
def concepts_in_catalog(spark, sf):
    """Parts are concepts of their document and of the next but one, whose catalogs name every third part."""
    p = table(spark, sf, "part")
    doc = F.expr("p_partkey div 40").cast("long")
    names = p.where("p_partkey % 3 = 0").select(doc.alias("doc_id"), F.concat_ws("  ", "p_type", "p_name").alias("name"))
    concepts = p.select(F.col("p_partkey").alias("concept"), F.concat(F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.lit(" (note)")).alias("name"), F.array(doc, doc + 2).alias("docs"))
    return resolution.in_catalog(concepts, names).select("concept", "doc_id", F.round("share", 6).alias("share"))
