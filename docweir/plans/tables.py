"""Tables of the data model, derived by Spark from the given tables, so that they grow with them.

Each has a SQL twin in SQL, which the oracle queries build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Documents with versions: an order stands for a document; the earlier order of its customer is what it
#: supersedes, but for every third document, which begins a chain. Flags may be missing.
VERSIONS = """
select o_orderkey as id, concat('Văn bản ', cast(o_orderkey as varchar(20))) as title,
  case when o_orderkey % 7 = 0 then null when o_orderstatus = 'F' then false else true end as is_active,
  case when o_orderkey % 5 = 0 then null else o_orderdate end as effective_date,
  cast(null as timestamp) as expiry_date,
  case when o_orderkey % 3 <> 0 then lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) end as supersedes_id,
  cast(null as bigint) as superseded_by_id, o_orderdate as created_at, o_custkey as owner
from orders
"""
#: Texts of the same documents with numbers of the document before, in several wordings.
CITING = """
select id, concat('Điều ', cast(id % 9 + 1 as varchar(20)), '. ', case id % 6
    when 0 then concat('Căn cứ ', prev, ' về việc quản lý hồ sơ.')
    when 1 then concat('Văn bản này thay thế ', prev, ', tiếp tục có hiệu lực Phụ lục 02 về biểu phí; phần còn lại hết hiệu lực.')
    when 2 then concat('Xem ', prev, ' hiện hành khi xử lý.')
    when 3 then concat('Khi khác nhau thì ưu tiên ', prev, '. Căn cứ ', prev, ' để đối chiếu, thay thế ', own, ' trước đây.')
    when 4 then concat('Không có viện dẫn tới ', prev, ' ở đây.')
    else 'Không có số hiệu nào.' end) as text, own
from (select o_orderkey as id,
    concat(cast(o_orderkey % 97 + 1 as varchar(20)), '/', cast(2010 + o_custkey % 15 as varchar(20)), '/', case o_orderkey % 3 when 0 then 'NĐ-CP' when 1 then 'TT-NHNN' else 'QĐ-DDB' end) as own,
    concat(cast(o_custkey % 89 + 1 as varchar(20)), '/', cast(2010 + o_orderkey % 15 as varchar(20)), '/', case o_custkey % 3 when 0 then 'NĐ-CP' when 1 then 'TT-NHNN' else 'QĐ-DDB' end) as prev
  from orders) x
"""
#: A graph: suppliers stand for documents, parts for values, brands and types for concepts.
VERTICES = """
select concat('d', cast(s_suppkey as varchar(20))) as entity_id, 'VanBan' as entity_type, s_name as description, s_nationkey % 12 as number from supplier
union all select concat('v', cast(p_partkey as varchar(20))), case when p_partkey % 50 = 0 then null else 'GiaTriQuyDinh' end, p_name, null from part
union all select distinct concat('k', p_brand), 'KhaiNiem', concat('brand ', p_brand), null from part
"""
EDGES = """
select distinct concat('d', cast(l_suppkey as varchar(20))) as src, concat('v', cast(l_partkey as varchar(20))) as dst, case when l_returnflag = 'R' then null when l_returnflag = 'A' then 'THAM_CHIEU' else 'QUY_DINH' end as relation, false as partial, cast(null as varchar(20)) as scope from lineitem
union all select concat('v', cast(p_partkey as varchar(20))), concat('k', p_brand), 'AP_DUNG_CHO', false, cast(null as varchar(20)) from part where p_partkey % 4 <> 0
union all select src, dst, relation, partial, scope from (select distinct concat('d', cast(a.s_suppkey as varchar(20))) as src, concat('d', cast(b.s_suppkey as varchar(20))) as dst, case (a.s_suppkey + b.s_suppkey) % 3 when 0 then 'CAN_CU' when 1 then 'THAY_THE' else 'THAM_CHIEU' end as relation, a.s_suppkey % 2 = 0 as partial, case when b.s_suppkey % 5 = 0 then 'Phụ lục 02' end as scope from (select s_suppkey, s_suppkey + 1 as other from supplier union all select s_suppkey, s_suppkey - 1 from supplier union all select s_suppkey, s_suppkey * 3 from supplier) a join supplier b on b.s_suppkey = a.other) y where src <> dst
"""
#: Paths of a catalog: forty parts stand for a document, types and brands for headings.
PATHS = """
select cast(floor(p_partkey / 40.0) as bigint) as doc_id, cast(p_partkey as bigint) as ord, case p_partkey % 4 when 0 then p_type when 1 then upper(p_type) else concat(' ', p_type) end as a, case when p_partkey % 11 = 0 then p_type when p_partkey % 13 = 0 then '12 3' else p_brand end as b, p_name as c from part
"""
SQL = {"versions": VERSIONS, "citing": CITING, "vertices": VERTICES, "edges": EDGES, "paths": PATHS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of SQL over them."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = [t for t in ("orders", "lineitem", "supplier", "part") if t in SQL[name]]
    query = SQL[name]
    for t in base:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"docweir_{t}")
        for before in ("from ", "join "):
            query = query.replace(f"{before}{t}", f"{before}docweir_{t}")
    return spark.sql(query)
