"""Registered drill-down queries (H1-H3, W1-W3) with their DuckDB oracles."""

from __future__ import annotations

from ..operators import drilldown as D
from . import duck_sql as Q
from .registry import query

_H1_LEAF = f"""
leaf0 AS (
  SELECT supplier, category, product_code, product_name,
         coalesce(sum(net_sales), 0) AS net, coalesce(sum(sold_qty), 0.0) AS qty
  FROM sales WHERE supplier IS NOT NULL AND category IS NOT NULL {{extra}}
  GROUP BY supplier, category, product_code, product_name),
leaf1 AS (
  SELECT *, coalesce({Q.base_code('product_name')}, nullif(product_code, ''), '기타') AS base_code,
         {Q.group_name('product_name')} AS rep
  FROM leaf0),
leaf AS (SELECT *, {Q.option_label('product_name', 'base_code')} AS option_name FROM leaf1),
grp AS (
  SELECT supplier, category, base_code, sum(net) AS group_total, sum(qty) AS group_qty,
         count(*) AS option_count,
         coalesce(arg_min(rep, row(-net, product_code, product_name)) FILTER (WHERE rep <> ''), '')
           AS group_name
  FROM leaf GROUP BY supplier, category, base_code),
cat AS (SELECT supplier, category, sum(group_total) AS category_total,
               sum(group_qty) AS category_qty FROM grp GROUP BY supplier, category),
sup AS (SELECT supplier, sum(category_total) AS supplier_total, sum(category_qty) AS supplier_qty
        FROM cat GROUP BY supplier),
kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY supplier, category
                                             ORDER BY group_total DESC, base_code) AS group_rank
                 FROM grp) WHERE group_rank <= 50)
"""

_H1_SELECT = """
SELECT l.supplier, cast(s.supplier_total AS double) AS supplier_total, s.supplier_qty,
       l.category, cast(c.category_total AS double) AS category_total, c.category_qty,
       l.base_code, k.group_name, cast(k.group_total AS double) AS group_total, k.group_qty,
       k.option_count, k.group_rank, l.product_code, l.product_name, l.option_name,
       cast(l.net AS double) AS net_sales, l.qty AS sold_qty
FROM leaf l
JOIN kept k ON l.supplier = k.supplier AND l.category = k.category AND l.base_code = k.base_code
JOIN cat c ON l.supplier = c.supplier AND l.category = c.category
JOIN sup s ON l.supplier = s.supplier"""


def _h1_sql(extra: str = "") -> str:
    return "," + _H1_LEAF.format(extra=extra) + _H1_SELECT


# The fixture WITH clause is emitted ahead of the query text, so the H1
# CTEs are appended to it with a leading comma.
@query("supplier_category_matrix", views=("sales",), sql=_h1_sql())
def _h1(fx):
    """H1: supplier -> category -> product group (top 50) -> option, flat."""
    return D.supplier_category_matrix(fx.sales)


@query("supplier_category_matrix_file", views=("sales",), sql=_h1_sql("AND file_id = 4"))
def _h1f(fx):
    """H1 for one loaded file (file_id = 4)."""
    return D.supplier_category_matrix(fx.sales, file_id=4)


@query("matrix_export", views=("sales",), sql="," + _H1_LEAF.format(extra="") + """
SELECT l.supplier, l.category, l.product_code, l.product_name,
       cast(l.net AS double) AS net_sales, l.qty AS sold_qty
FROM leaf l
JOIN kept k ON l.supplier = k.supplier AND l.category = k.category AND l.base_code = k.base_code""")
def _h3(fx):
    """H3: export rows of the supplier drill-down."""
    return D.matrix_export(fx.sales)


@query("store_category_matrix", views=("store_sales",), sql=""",
leaf AS (
  SELECT store, classification, product_code, product_name,
         coalesce(sum(net_sales), 0) AS net, coalesce(sum(sold_qty), 0.0) AS qty,
         CASE WHEN classification = '' THEN '기타' ELSE classification END AS category
  FROM store_sales WHERE store IS NOT NULL AND classification IS NOT NULL
  GROUP BY store, classification, product_code, product_name),
cat AS (SELECT store, category, sum(net) AS category_total, sum(qty) AS category_qty
        FROM leaf GROUP BY store, category),
st AS (SELECT store, sum(category_total) AS store_total, sum(category_qty) AS store_qty
       FROM cat GROUP BY store),
best AS (SELECT *, row_number() OVER (ORDER BY store_total DESC, store) AS store_rank FROM st
         ORDER BY store_total DESC, store LIMIT 50),
ranked AS (
  SELECT * FROM (
    SELECT l.*, row_number() OVER (PARTITION BY l.store, l.category
      ORDER BY l.net DESC, l.product_code NULLS FIRST, l.product_name NULLS FIRST) AS product_rank
    FROM leaf l WHERE l.store IN (SELECT store FROM best)) WHERE product_rank <= 15)
SELECT r.store, cast(b.store_total AS double) AS store_total, b.store_qty, b.store_rank,
       r.category, cast(c.category_total AS double) AS category_total, c.category_qty,
       r.product_rank, r.product_code, r.product_name,
       cast(r.net AS double) AS net_sales, r.qty AS sold_qty
FROM ranked r JOIN cat c ON r.store = c.store AND r.category = c.category
JOIN best b ON r.store = b.store""")
def _h2(fx):
    """H2: store (top 50) -> classification -> product (top 15), flat."""
    return D.store_category_matrix(fx.store_sales)
