"""Registered sales queries (A1-A10, A13, A14) with their DuckDB oracles."""

from __future__ import annotations

from ..operators import maintain, sales as S
from .registry import query

# Monday-based week number: strftime('%W') + 1.
_WEEK_SQL = ("strftime(sale_date, '%Y') || '-W' || "
             "lpad(cast(cast(strftime(sale_date, '%W') as integer) + 1 as varchar), 2, '0')")


@query("summary_stats", views=("sales",), sql="""
SELECT count(*) AS total_records, cast(sum(net_sales) AS double) AS total_sales,
       sum(sold_qty) AS total_qty, count(DISTINCT product_code) AS unique_products,
       count(DISTINCT supplier) AS unique_suppliers, count(DISTINCT category) AS unique_categories
FROM sales""")
def _a1(fx):
    """A1: sales KPIs over the whole sales table."""
    return S.summary_stats(fx.sales)


@query("summary_stats_file", views=("sales",), sql="""
SELECT count(*) AS total_records, cast(sum(net_sales) AS double) AS total_sales,
       sum(sold_qty) AS total_qty, count(DISTINCT product_code) AS unique_products,
       count(DISTINCT supplier) AS unique_suppliers, count(DISTINCT category) AS unique_categories
FROM sales WHERE file_id = 2""")
def _a1f(fx):
    """A1 restricted to one loaded file (file_id = 2)."""
    return S.summary_stats(fx.sales, file_id=2)


@query("store_summary", views=("store_sales",), sql="""
SELECT count(*) AS total_records, cast(sum(net_sales) AS double) AS total_sales,
       sum(sold_qty) AS total_qty, count(DISTINCT store) AS unique_stores
FROM store_sales WHERE sale_date >= DATE '1994-01-01' AND sale_date <= DATE '1996-12-31'""")
def _a2(fx):
    """A2: store KPIs for a date range."""
    return S.store_summary(fx.store_sales, start_date="1994-01-01", end_date="1996-12-31")


@query("rows_by_data_type", views=("store_sales",), sql="""
SELECT data_type, count(*) AS row_count FROM store_sales
WHERE data_type IS NOT NULL AND data_type <> '' GROUP BY data_type""")
def _a3(fx):
    """A3: store rows per data type."""
    return S.rows_by_data_type(fx.store_sales)


_BY_KEY = """
SELECT {k}, cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(DISTINCT product_code) AS product_count
FROM sales WHERE {k} IS NOT NULL AND {k} <> '' {extra}
GROUP BY {k} ORDER BY net_sales DESC NULLS LAST, {k} LIMIT 30"""


@query("sales_by_supplier", views=("sales",), sql=_BY_KEY.format(k="supplier", extra=""))
def _a4(fx):
    """A4: top 30 suppliers by net sales."""
    return S.sales_by_supplier(fx.sales)


@query("sales_by_supplier_file", views=("sales",),
       sql=_BY_KEY.format(k="supplier", extra="AND file_id = 3"))
def _a4f(fx):
    """A4 for one file (file_id = 3)."""
    return S.sales_by_supplier(fx.sales, file_id=3)


@query("sales_by_category", views=("sales",), sql=_BY_KEY.format(k="category", extra=""))
def _a5(fx):
    """A5: top 30 categories by net sales."""
    return S.sales_by_category(fx.sales)


@query("top_products", views=("sales",), sql="""
SELECT product_code, product_name, min(classification) AS classification,
       min(supplier) AS supplier, min(category) AS category,
       cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty
FROM sales GROUP BY product_code, product_name
ORDER BY net_sales DESC NULLS LAST, product_code NULLS FIRST, product_name NULLS FIRST
LIMIT 100""")
def _a6(fx):
    """Top 100 products by net sales."""
    return S.top_products(fx.sales)


@query("daily_sales", views=("store_sales",), sql="""
SELECT sale_date, cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(*) AS row_count
FROM store_sales WHERE sale_date IS NOT NULL GROUP BY sale_date ORDER BY sale_date""")
def _a7(fx):
    """Daily series over all store lines."""
    return S.daily_sales(fx.store_sales)


@query("daily_sales_file_range", views=("store_sales",), sql="""
SELECT sale_date, cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(*) AS row_count
FROM store_sales WHERE sale_date IS NOT NULL AND file_id = 1
  AND sale_date >= DATE '1995-03-01' AND sale_date <= DATE '1995-09-30'
GROUP BY sale_date ORDER BY sale_date""")
def _a7f(fx):
    """A7 for one file and an inclusive date range."""
    return S.daily_sales(fx.store_sales, file_id=1, start_date="1995-03-01", end_date="1995-09-30")


@query("weekly_sales", views=("store_sales",), sql=f"""
SELECT {_WEEK_SQL} AS week, min(sale_date) AS start_date, max(sale_date) AS end_date,
       cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(*) AS row_count, count(DISTINCT store) AS store_count
FROM store_sales WHERE sale_date IS NOT NULL GROUP BY 1 ORDER BY 1""")
def _a8(fx):
    """Weekly series, Monday-based week numbers."""
    return S.weekly_sales(fx.store_sales)


@query("weekly_sales_iso", views=("store_sales",), sql="""
SELECT strftime(sale_date, '%Y') || '-W' || lpad(cast(weekofyear(sale_date) AS varchar), 2, '0') AS week,
       min(sale_date) AS start_date, max(sale_date) AS end_date,
       cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(*) AS row_count, count(DISTINCT store) AS store_count
FROM store_sales WHERE sale_date IS NOT NULL GROUP BY 1 ORDER BY 1""")
def _a8i(fx):
    """A8 with ISO week numbers and the calendar year."""
    return S.weekly_sales(fx.store_sales, week_mode="iso")


@query("monthly_sales", views=("store_sales",), sql="""
SELECT strftime(sale_date, '%Y-%m') AS month, cast(sum(net_sales) AS double) AS net_sales,
       sum(sold_qty) AS sold_qty, count(*) AS row_count, count(DISTINCT store) AS store_count
FROM store_sales WHERE sale_date IS NOT NULL GROUP BY 1 ORDER BY 1""")
def _a9(fx):
    """Monthly series."""
    return S.monthly_sales(fx.store_sales)


@query("store_sales_top", views=("store_sales",), sql="""
SELECT store, cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(*) AS row_count
FROM store_sales WHERE store IS NOT NULL AND store <> ''
GROUP BY store ORDER BY net_sales DESC NULLS LAST, store LIMIT 30""")
def _a10(fx):
    """A10: top 30 stores by net sales."""
    return S.store_sales_top(fx.store_sales)


@query("available_years", views=("store_sales",), sql="""
SELECT DISTINCT cast(year(sale_date) AS integer) AS year FROM store_sales
WHERE sale_date IS NOT NULL ORDER BY year DESC""")
def _a13(fx):
    """Years present in the store table."""
    return S.available_years(fx.store_sales)


@query("data_counts", views=("sales", "store_sales"), sql="""
SELECT 'sales' AS table_name, count(*) AS row_count FROM sales
UNION ALL SELECT 'store_sales', count(*) FROM store_sales
UNION ALL SELECT 'files', count(*) FROM (
  SELECT file_id FROM sales UNION SELECT file_id FROM store_sales)""")
def _a14(fx):
    """Row counts of the two fact tables and of the file registry
    derived from them."""
    files = maintain.derive_files(fx.sales, fx.store_sales)
    return S.data_counts(sales=fx.sales, store_sales=fx.store_sales, files=files)


@query("rows_by_data_type_filtered", views=("store_sales",), sql="""
SELECT data_type, count(*) AS row_count FROM store_sales
WHERE data_type IS NOT NULL AND data_type <> '' AND file_id = 2
  AND sale_date >= DATE '1996-01-01' AND sale_date <= DATE '1997-06-30'
GROUP BY data_type""")
def _a3f(fx):
    """A3 with the file and date filters applied."""
    return S.rows_by_data_type(fx.store_sales, file_id=2, start_date="1996-01-01",
                               end_date="1997-06-30")


@query("top_products_by_code", views=("sales",), sql="""
SELECT product_code, min(product_name) AS product_name, min(classification) AS classification,
       min(supplier) AS supplier, min(category) AS category,
       cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty
FROM sales WHERE product_code IS NOT NULL AND product_code <> ''
GROUP BY product_code ORDER BY net_sales DESC NULLS LAST, product_code NULLS FIRST LIMIT 100""")
def _a6c(fx):
    """A6 grouped by product code only (non-empty codes)."""
    return S.top_products(fx.sales, by="code")
