"""Registered explorer queries (X1-X6, W4, W5, O3, S15) with their oracles.

The explorer input is the loaded sales rows without internal columns (S15
without its file filter, so the views run over the whole table); the
``file_rows`` query shows S15 with its file filter.
"""

from __future__ import annotations

from ..operators import catalog as K, explore as X, sales as S
from ..sources.export import file_rows
from .registry import query

_INPUT = "(SELECT * EXCLUDE (file_id) FROM sales)"


def _explorer_input(fx):
    return file_rows(fx.sales)


@query("file_rows", views=("sales",),
       sql="SELECT * EXCLUDE (file_id) FROM sales WHERE file_id = 1")
def _s15(fx):
    """Raw rows of one file without internal columns."""
    return file_rows(fx.sales, file_id=1)


def _x1_sql(key: str, agg: str) -> str:
    return f"""
SELECT key, value, row_number() OVER (ORDER BY value DESC, key) AS rank FROM (
  SELECT CASE WHEN {key} IS NULL OR {key} = '' THEN '(없음)' ELSE {key} END AS key,
         cast({agg} AS double) AS value
  FROM {_INPUT} GROUP BY 1 ORDER BY value DESC, key LIMIT 20)"""


@query("explore_sum", views=("sales",), sql=_x1_sql("supplier", "sum(coalesce(sold_qty, 0))"))
def _x1s(fx):
    """Suppliers by summed quantity, top 20."""
    return X.group_measure(_explorer_input(fx), "supplier", "sold_qty", "sum")


@query("explore_avg", views=("sales",), sql=_x1_sql("category", "avg(coalesce(sold_qty, 0))"))
def _x1a(fx):
    """Categories by average quantity, top 20."""
    return X.group_measure(_explorer_input(fx), "category", "sold_qty", "avg")


@query("explore_max", views=("sales",), sql=_x1_sql("product_name", "max(coalesce(net_sales, 0))"))
def _x1m(fx):
    """Product names by largest net sales line, top 20."""
    return X.group_measure(_explorer_input(fx), "product_name", "net_sales", "max")


@query("explore_count", views=("sales",), sql=_x1_sql("classification", "count(*)"))
def _x1c(fx):
    """Classifications by row count, top 20."""
    return X.group_measure(_explorer_input(fx), "classification", X.COUNT_MEASURE, "count")


@query("explore_profile", views=("sales",), sql=f""",
t AS (SELECT count(*) AS n, sum(coalesce(sold_qty, 0)) AS s0, count(sold_qty) AS c0,
                  sum(coalesce(cancel_qty, 0)) AS s1, count(cancel_qty) AS c1,
                  cast(sum(coalesce(net_sales, 0)) AS double) AS s2, count(net_sales) AS c2
           FROM {_INPUT})
SELECT 'rows' AS stat, NULL::varchar AS column_name, cast(n AS double) AS value, 0 AS position FROM t
UNION ALL SELECT 'columns', NULL, 8.0, 0 FROM t
UNION ALL SELECT 'sum', 'sold_qty', s0, 0 FROM t WHERE c0 > 0
UNION ALL SELECT 'sum', 'cancel_qty', s1, 1 FROM t WHERE c1 > 0
UNION ALL SELECT 'sum', 'net_sales', s2, 2 FROM t WHERE c2 > 0""")
def _x2(fx):
    """Rows, columns and sums of the first four numeric columns."""
    return X.profile(_explorer_input(fx))


_NUM = r"regexp_full_match(trim(replace({c}, ',', '')), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"


def _roles_sql() -> str:
    typed = [("l_orderkey", "num"), ("l_linenumber", "num")]
    text = ["qty_text", "date_text", "money_text", "code_text", "product_name", "store", "classification"]
    parts = []
    for i, (c, _) in enumerate(typed):
        parts.append(f"SELECT {i} AS position, '{c}' AS column_name, "
                     f"coalesce(bool_or({c} IS NOT NULL), false) AS is_numeric, false AS is_text "
                     f"FROM raw_lines")
    for j, c in enumerate(text, start=len(typed)):
        num = _NUM.format(c=c)
        parts.append(f"SELECT {j}, '{c}', coalesce(bool_or({c} IS NOT NULL AND {num}), false), "
                     f"coalesce(bool_or({c} IS NOT NULL AND NOT {num}), false) FROM raw_lines")
    return "\nUNION ALL ".join(parts)


@query("explore_roles", views=("raw_lines",), sql=_roles_sql())
def _x3(fx):
    """Numeric / text roles of the raw (all-text) upload columns."""
    return X.column_roles(fx.raw_lines)


@query("explore_top_items", views=("sales",), sql=f"""
SELECT name, value, row_number() OVER (ORDER BY value DESC, name NULLS FIRST) AS rank FROM (
  SELECT coalesce(CASE WHEN product_name <> '' THEN product_name END, classification) AS name,
         cast(sum(coalesce(sold_qty, 0)) AS double) AS value
  FROM {_INPUT} GROUP BY 1 ORDER BY value DESC, name NULLS FIRST LIMIT 20)""")
def _x4(fx):
    """Top 20 product names by summed quantity."""
    return X.top_items(_explorer_input(fx), "sold_qty")


def _months_sql() -> str:
    present = {"1월": 1, "2월": 2, "3월": 3}
    sums = ", ".join(f'cast(sum(coalesce("{m}", 0)) AS double) AS v{i}' for m, i in present.items())
    rows = []
    for i, m in enumerate(X.MONTH_COLUMNS, start=1):
        v = f"v{i}" if m in present else "0.0"
        rows.append(f"SELECT {i} AS position, '{m}' AS month, {v} AS qty, "
                    f"CASE WHEN total > 0 THEN round({v} / total * 100, 1) ELSE 0.0 END AS share FROM t")
    rows.append(f"SELECT 13, '{X.TOTAL_LABEL}', total, 100.0 FROM t")
    return (f"SELECT *, v1 + v2 + v3 AS total FROM (SELECT {sums} FROM wide_months)",
            "\nUNION ALL ".join(rows))


_M_T, _M_ROWS = _months_sql()


@query("explore_monthly", views=("wide_months",), sql=f", t AS ({_M_T})\n{_M_ROWS}")
def _x5(fx):
    """Month totals and shares of the wide month table."""
    return X.monthly_view(fx.wide_months)


@query("explore_preview", views=("sales",), sql=f"""
SELECT * FROM {_INPUT} ORDER BY classification NULLS FIRST, category NULLS FIRST,
  supplier NULLS FIRST, product_code NULLS FIRST, product_name NULLS FIRST, sold_qty NULLS FIRST,
  cancel_qty NULLS FIRST, net_sales NULLS FIRST LIMIT 500""")
def _x6(fx):
    """First 500 rows in a total order."""
    df = _explorer_input(fx)
    return X.preview(df, 500, order_by=df.columns)


@query("supplier_share", views=("sales",), sql="""
SELECT supplier, net_sales, sold_qty, product_count,
       CASE WHEN sum(net_sales) OVER () > 0
            THEN round(net_sales / sum(net_sales) OVER () * 100, 1) ELSE 0.0 END AS share
FROM (SELECT supplier, cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
             count(DISTINCT product_code) AS product_count
      FROM sales WHERE supplier IS NOT NULL AND supplier <> '' GROUP BY supplier)""")
def _w4(fx):
    """Every supplier's share of total net sales (percent, 1 decimal)."""
    return X.with_share(S.sales_by_supplier(fx.sales, top=None), "net_sales")


@query("catalog_page", views=("product_images",), sql="""
SELECT * FROM (
  SELECT product_code, min(product_name) AS product_name,
         string_agg(DISTINCT supplier_option, ',' ORDER BY supplier_option) AS supplier_option,
         min(image_url) AS image_url, count(*) AS option_count
  FROM product_images GROUP BY product_code)
ORDER BY product_name NULLS FIRST, product_code NULLS FIRST LIMIT 50 OFFSET 100""")
def _o3(fx):
    """O3: third page (50 rows) of the grouped catalog."""
    return X.page(K.catalog_groups(fx.product_images), ["product_name", "product_code"], 3, 50)


@query("catalog_pages", views=("product_images",),
       sql="SELECT cast(ceil(count(DISTINCT product_code) / 50) AS bigint) AS pages "
           "FROM product_images")
def _o3n(fx):
    """O3: page count of the grouped catalog at 50 per page."""
    return X.page_count(K.catalog_groups(fx.product_images), 50)


_DOTTED = """(SELECT supplier AS g, sold_qty AS v, CASE WHEN file_id = 4 THEN 0 ELSE file_id END AS n FROM sales)"""


@query("explore_dotted", views=("sales",), sql=f"""
SELECT 'group' AS view, key, value, row_number() OVER (ORDER BY value DESC, key) AS rank FROM (
  SELECT g AS key, cast(sum(coalesce(v, 0)) AS double) AS value FROM {_DOTTED} GROUP BY 1 ORDER BY value DESC, key LIMIT 20)
UNION ALL
SELECT 'item', key, value, row_number() OVER (ORDER BY value DESC, key) FROM (
  SELECT CASE WHEN n = 0 THEN g ELSE cast(n AS varchar) END AS key, cast(sum(coalesce(v, 0)) AS double) AS value
  FROM {_DOTTED} GROUP BY 1 ORDER BY value DESC, key LIMIT 20)""")
def _x14d(fx):
    """X1 and X4 over a table whose headers hold dots and whose name column is
    numeric (0 counts as empty, so the first column names the row)."""
    df = fx.sales.selectExpr("supplier AS `품목.코드`", "sold_qty AS `판매.수량`",
                             "CASE WHEN file_id = 4 THEN 0 ELSE file_id END AS `이름.번호`")
    a = X.group_measure(df, "품목.코드", "판매.수량", "sum")
    b = X.top_items(df, "판매.수량", name_col="이름.번호").withColumnRenamed("name", "key")
    return a.selectExpr("'group' AS view", "key", "value", "rank").unionByName(
        b.selectExpr("'item' AS view", "key", "value", "rank"))


@query("catalog_page_after", views=("product_images",), sql="""
SELECT * FROM product_images WHERE (product_code, barcode) > ('00007', '8800000000036')
ORDER BY product_code, barcode LIMIT 50""")
def _o3k(fx):
    """O3 by key: the 50 catalog rows after a given one."""
    return X.page_after(fx.product_images, ["product_code", "barcode"],
                        {"product_code": "00007", "barcode": "8800000000036"})
