"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_byte_bpe
from .embedding_join import op2_embedding_dedup
from .jaccard_join import op6_ngram_jaccard_join
from .language_id import op3_language_id
from .lexical_search import op13_lexical_search
from .license_scan import op5_license_scan
from .line_dedup import op1_line_dedup
from .mixing import op7_source_mixing
from .periodic_runs import op12_periodic_runs
from .perplexity import op9_kneser_ney_quality
from .quality_rules import op10_quality_rules
from .suffix_dedup import op11_suffix_dedup
from .token_packing import op8_token_packing



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py at the top of the repository, which an installed package may lack.
    No SQL: expectation-maximisation, permutations and BPE are beyond it."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_packing": op8_token_packing,
    "op9_kneser_ney_quality": op9_kneser_ney_quality,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}
#: Plain SQL for those that it can express. Reachability is a recursive union of pairs.
ORACLES = {
    "op2_embedding_dedup": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v),
pair as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id where a.n > 0 and b.n > 0 and list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach as (select vec_id as id, vec_id as r from embeddings union select reach.id, pair.b from reach join pair on pair.a = reach.r),
least as (select id, min(r) as component_id from reach group by id),
links as (select a, count(*) as n from pair group by a)
select e.vec_id, coalesce(links.n, 0)::bigint as n_links, least.component_id, e.vec_id = least.component_id as kept
from embeddings e join least on least.id = e.vec_id left join links on links.a = e.vec_id""",
    "op6_ngram_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as i from w where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i : i + 3], chr(10)) as g from i),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
pair as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as id, doc_id as r from documents union select reach.id, pair.b from reach join pair on pair.a = reach.r),
least as (select id, min(r) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least.component_id from documents d join least on least.id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op12_periodic_runs": r"""
with recursive c as (select doc_id, list_reduce([4294967295] || [ascii(x)::bigint for x in string_split(doc_id::varchar, '')], lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)) as s, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
h as (select doc_id, xor(s, 4294967295) as h, coalesce(w, []) as w, len(coalesce(w, [])) as n from c),
p as (select doc_id, w, n, h // 10 % greatest(n, 1) as a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) as p, h % 10 = 0 and n > 0 as planted from h),
i as (select *, unnest(generate_series(0, n - 1)) as i from p),
w as (select doc_id, n, i, case when planted and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as w from i),
same as (select y.doc_id, y.i - x.i as q, y.i from w x join w y on y.doc_id = x.doc_id and y.w = x.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
part as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from same),
diagonal as (select doc_id, q, min(i) - q as start, count(*) + q as length from part group by doc_id, q, part having count(*) + q >= greatest(6, 4 * q)),
run as (select doc_id, start, length, q as period from diagonal d where not exists (select 1 from diagonal s where s.doc_id = d.doc_id and s.q < d.q and s.start <= d.start and s.start + s.length >= d.start + d.length)),
gone as (select distinct doc_id, unnest(generate_series(start + period, start + length - 1)) as i from run),
kept as (select doc_id, string_agg(w, ' ' order by i) as text from w anti join gone using (doc_id, i) group by doc_id),
list as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs, first(struct_pack(start := start, length := length, period := period) order by length desc, start, period) as top from run group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.start::bigint as start, top.length::bigint as length, top.period::bigint as period, (1000 * top.length // top.period)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from documents d left join list on list.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id""",
    "op13_lexical_search": r"""
with d as (select doc_id, row_number() over () as k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
s as (select count(*) as n_docs, sum(len(t))::bigint as total from d where len(t) > 0),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
p as (select k, doc_id, t, n, count(*) as tf from (select k, doc_id, len(t) as n, unnest(t) as t from d) where t in (select t from i) group by all),
w as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by t, n_docs),
x as (select k, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // total))) as x from p join w using (t), s),
r as (select item_id, k, doc_id, sum(x)::bigint as score from x join i using (t) group by all having sum(x) > 0),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from r)
select * from o where rank <= 50""",
    "op11_suffix_dedup": r"""
with d as (select row_number() over () as k, doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
p as (select k, h, unnest(generate_series(0, len(h) // 2 - 200)) as s from d where len(h) >= 400),
w as (select k, s, md5_number(substr(h, 2 * s + 1, 400)) as g from p),
r as (select k, s from w where g in (select g from w group by g having count(*) > 1)),
n as (select k, s, s - lag(s) over (partition by k order by s) > 200 as far from r),
g as (select k, s, sum(case when far then 1 else 0 end) over (partition by k order by s) as g from n),
gone as (select k, min(s) as b, max(s) + 200 as e from g group by k, g.g),
ends as (select k, e as b, lead(b, 1) over (partition by k order by b) as e from gone union all select k, 0, min(b) from gone group by k),
kept as (select k, string_agg(substr(h, 2 * b + 1, 2 * (coalesce(e, len(h) // 2) - b)), '' order by b) as rest from ends join d using (k) group by k),
sums as (select k, sum(e - b)::bigint as n_removed, count(*) as n_spans from gone group by k)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from d left join sums using (k) left join kept using (k)""",
}
