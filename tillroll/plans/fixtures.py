"""Stand-in input tables derived from the driver's TPC-H-style Parquet files.

The reference ships no data, so the sales, store-sales, catalog, stock and
raw-line tables are derived views (FIXTURES.md section 4). The same SQL text
runs in Spark (``spark.sql`` with DataFrame arguments, no global temp views)
and in DuckDB (as CTEs in the oracle), so both engines see identical input.
These views only give rows in the expected schema; every query's own work
happens in the library operators on top of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

VIEW_SQL: dict[str, str] = {
    "named_part": """
select *, case when p_partkey % 10 = 9 then p_name
  else 'BJK' || lpad(cast(p_partkey % 300 as string), 3, '0') || '_[' || substr(p_brand, 7)
       || '-' || cast(p_size as string) || ']' || p_name end as product_name
from part""",
    "sales": """
select cast(l_orderkey % 4 + 1 as int) as file_id,
  case when l_linenumber = 7 then p_type
       else p_type || ' ' || p_brand || '(' || s_name || ')' end as classification,
  case when l_linenumber = 7 then p_type else p_type || ' ' || p_brand end as category,
  case when l_linenumber = 7 then '미지정' else s_name end as supplier,
  lpad(cast(p_partkey as string), 5, '0') as product_code, product_name,
  l_quantity as sold_qty,
  case when l_returnflag = 'R' then l_quantity else 0.0e0 end as cancel_qty,
  cast(cast(l_extendedprice as decimal(18,2)) * cast(1 - cast(l_discount as decimal(4,2)) as decimal(5,2)) as decimal(18,4)) as net_sales
from lineitem join named_part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""",
    "store_sales": """
select cast(l_orderkey % 4 + 1 as int) as file_id, c_mktsegment as data_type,
  cast(l_shipdate as date) as sale_date,
  'S' || lpad(cast(c_custkey % 120 as string), 3, '0') as store_code,
  n_name || ' #' || cast(c_custkey % 120 as string) as store,
  p_type || ' ' || p_brand || '(' || s_name || ')' as classification,
  lpad(cast(p_partkey as string), 5, '0') as product_code, product_name,
  l_quantity as sold_qty,
  cast(cast(l_extendedprice as decimal(18,2)) * cast(1 - cast(l_discount as decimal(4,2)) as decimal(5,2)) as decimal(18,4)) as net_sales
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join named_part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey""",
    "product_images": """
select case when p_partkey % 3 = 2 then 'SX' else 'SO' end || lpad(cast(p_partkey % 997 as string), 4, '0')
    || ' ' || p_type as supplier_option,
  case when cast(floor(p_partkey / 5.0) as int) % 7 = 3 then 'BJK' when cast(floor(p_partkey / 5.0) as int) % 7 = 5 then 'PT'
    else '' end || lpad(cast(cast(floor(p_partkey / 5.0) as int) as string), 5, '0') as product_code,
  case p_partkey % 11 when 1 then '티셔츠 ' when 2 then '바지 ' when 3 then '조끼 바지 ' when 4 then '모자 ' else '' end
    || product_name as product_name,
  '880' || lpad(cast(p_partkey as string), 10, '0') as barcode,
  'img/' || lpad(cast(cast(floor(p_partkey / 5.0) as int) as string), 5, '0') || '_500.png' as image_url
from named_part""",
    "inventory": """
select lpad(cast(cast(floor(p_partkey / 5.0) as int) as string), 5, '0') as product_code, s_name as supplier,
  p_name as product_name, p_type as option_name,
  p_retailprice as sale_price,
  'SO' || lpad(cast(p_partkey % 997 as string), 4, '0') || ' ' || p_type as supplier_option,
  case when p_partkey % 5 = 0 then 0 when p_partkey % 53 = 1 then -1 else p_size end as normal_stock,
  case when p_partkey % 5 = 0 then 0 else p_size - p_size % 3 end as available_stock
from (select *, p_partkey % (select max(s_suppkey) + 1 from supplier) as sk from part) p
left join supplier on s_suppkey = sk""",
    "raw_lines": """
select l_orderkey, l_linenumber,
  case l_linenumber % 4 when 0 then ' ' || cast(cast(l_quantity as int) as string) || ' '
    when 1 then '1,' || lpad(cast(cast(l_quantity as int) as string), 3, '0')
    when 2 then 'n/a' else cast(cast(l_quantity as int) as string) end as qty_text,
  case l_linenumber % 5 when 0 then cast(cast(l_shipdate as date) as string) || ' 09:00'
    when 1 then replace(cast(cast(l_shipdate as date) as string), '-', '/')
    when 2 then cast(35000 + l_orderkey % 3000 as string)
    when 3 then replace(cast(cast(l_shipdate as date) as string), '-', '')
    else 'unknown' end as date_text,
  case l_linenumber when 1 then '12,345,678,901,234,567.25' when 2 then '-0.5' when 3 then 'n/a'
    else cast(cast(l_extendedprice as decimal(18,2)) as string) end as money_text,
  lpad(cast(l_partkey as string), 5, '0') as code_text,
  case when l_orderkey % 50 = 0 then '7 row(s)' when l_orderkey % 51 = 0 then '' else product_name end as product_name,
  case when l_orderkey % 40 = 0 then '매장수: 3' when l_orderkey % 41 = 0 then null
       else 'store ' || cast(l_suppkey as string) end as store,
  case l_linenumber when 1 then p_type when 2 then 'a(b)c(d' when 3 then '' when 4 then null
       else p_type || ' ( ' || p_brand || ' ) ' end as classification
from lineitem join named_part on l_partkey = p_partkey""",
    "wide_months": """
select supplier as name,
  sum(case when file_id = 1 then sold_qty else 0.0e0 end) as `1월`,
  sum(case when file_id = 2 then sold_qty else 0.0e0 end) as `2월`,
  sum(case when file_id = 3 then sold_qty else 0.0e0 end) as `3월`
from sales group by supplier""",
}

# How Spark joins the tables of a view: the same inner joins, with the lines as
# narrow and as seldom shuffled as can be. The orders meet their customers before
# the lines meet the orders, and of keys and times goes on what the view's columns
# are made of (a remainder's remainder, or a date's date, is itself).
SPARK_FROM: dict[str, str] = {
    "sales": """
from (select l_partkey, l_suppkey, l_orderkey % 4 as l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice,
    l_discount from lineitem)
  join named_part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""",
    "store_sales": """
from (select l_partkey, l_suppkey, l_orderkey % 4 as l_orderkey, l_shipdate, l_quantity, l_extendedprice, l_discount,
    c_custkey, c_mktsegment, c_nationkey
    from (select l_orderkey, l_partkey, l_suppkey, cast(l_shipdate as date) as l_shipdate, l_quantity, l_extendedprice,
      l_discount from lineitem)
    join (select o_orderkey, c_custkey % 120 as c_custkey, c_mktsegment, c_nationkey
      from orders join customer on o_custkey = c_custkey) on l_orderkey = o_orderkey)
  join named_part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on c_nationkey = n_nationkey""",
}

# views each view reads (base tables or earlier views)
VIEW_DEPS: dict[str, list[str]] = {
    "named_part": ["part"],
    "sales": ["lineitem", "named_part", "supplier"],
    "store_sales": ["lineitem", "orders", "customer", "nation", "named_part", "supplier"],
    "product_images": ["named_part"],
    "inventory": ["part", "supplier"],
    "raw_lines": ["lineitem", "named_part"],
    "wide_months": ["sales"],
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in VIEW_DEPS.get(n, []):
            visit(d)
        if n in VIEW_SQL and n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def _spark_text(view: str, names: list[str]) -> str:
    import re

    sql = VIEW_SQL[view]
    if view in SPARK_FROM:
        sql = sql.rsplit("\nfrom ", 1)[0] + SPARK_FROM[view]
    for n in names:
        sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return sql


class Fixtures:
    """Lazily built fixture DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEW_SQL:
                deps = VIEW_DEPS[name]
                frames = {d: self.table(d) for d in deps}
                self._cache[name] = self.spark.sql(_spark_text(name, deps), **frames)
            else:
                self._cache[name] = self._read(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def duck_with(views: list[str]) -> str:
    """``WITH`` clause defining the given fixture views for DuckDB."""
    parts = []
    for n in _order(views):
        body = VIEW_SQL[n].replace("`", '"')
        parts.append(f"{n} AS ({body}\n)")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
