"""Sales questions: KPIs, top lists, day / week / month / store series.

All operators are declarative DataFrame plans: filters first (so they reach
the scan and prune ``file_id`` partitions of stored tables), one
``groupBy().agg()`` each (Spark's partial aggregation combines map-side, so a
supplier or store holding a third of the rows still ships one row per task),
and ``orderBy().limit()`` for top lists (TakeOrderedAndProject: each task
keeps only its own top k). Money is summed as decimal and returned as double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import month_key, week_label, week_number


def money(c) -> Column:
    """Decimal sum -> double at the output edge."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def with_file(df: DataFrame, file_id=None) -> DataFrame:
    """optional ``file_id`` equality (prunes partitions of stored tables)."""
    return df if file_id is None else df.filter(F.col("file_id") == F.lit(file_id))


def with_dates(df: DataFrame, start_date=None, end_date=None, col: str = "sale_date") -> DataFrame:
    """optional inclusive ``sale_date`` range (``YYYY-MM-DD`` text or date)."""
    if start_date is not None:
        df = df.filter(F.col(col) >= F.lit(start_date).cast("date"))
    if end_date is not None:
        df = df.filter(F.col(col) <= F.lit(end_date).cast("date"))
    return df


def non_empty(c: str) -> Column:
    """key neither null nor empty."""
    return F.col(c).isNotNull() & (F.col(c) != "")


def _totals(net="net_sales", qty="sold_qty"):
    return [money(F.sum(net)).alias("net_sales"), F.sum(qty).alias("sold_qty")]


# --- A1 / A2 / A3 ----------------------------------------------------------------
def _sum(c: str, zero: bool) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)) if zero else F.sum(c)


def _distinct(c: str, skip_empty: bool) -> Column:
    col = F.col(c)
    return F.countDistinct(F.when(col != "", col)) if skip_empty else F.countDistinct(col)


def summary_stats(sales: DataFrame, file_id=None, empty_sums_as_zero: bool = False,
                  skip_empty_in_distinct: bool = False) -> DataFrame:
    """A1: rows, net sales, quantity, distinct products / suppliers / categories.

    ``file_id`` is applied when given (the documented intent). By default
    sums over no rows are null and distinct counts skip nulls but count the
    empty string, as SQL does; the two flags give the other form of the
    source (0 for empty sums, empty strings not counted).
    """
    df = with_file(sales.select("file_id", "net_sales", "sold_qty", "product_code",
                                "supplier", "category"), file_id)
    z, e = empty_sums_as_zero, skip_empty_in_distinct
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        money(_sum("net_sales", z)).alias("total_sales"),
        _sum("sold_qty", z).cast("double").alias("total_qty"),
        _distinct("product_code", e).alias("unique_products"),
        _distinct("supplier", e).alias("unique_suppliers"),
        _distinct("category", e).alias("unique_categories"),
    )


def store_summary(store_sales: DataFrame, file_id=None, start_date=None, end_date=None,
                  empty_sums_as_zero: bool = False, skip_empty_in_distinct: bool = False
                  ) -> DataFrame:
    """A2: store-table rows, net sales, quantity and distinct stores (same
    flags as :func:`summary_stats`)."""
    df = with_dates(with_file(store_sales, file_id), start_date, end_date)
    z = empty_sums_as_zero
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        money(_sum("net_sales", z)).alias("total_sales"),
        _sum("sold_qty", z).cast("double").alias("total_qty"),
        _distinct("store", skip_empty_in_distinct).alias("unique_stores"),
    )


def rows_by_data_type(store_sales: DataFrame, file_id=None, start_date=None,
                      end_date=None) -> DataFrame:
    """A3: row count per data_type; null and empty types are omitted.

    Filters default to none (the SQL form ignores them); pass them to apply.
    """
    df = with_dates(with_file(store_sales, file_id), start_date, end_date)
    return (df.filter(non_empty("data_type")).groupBy("data_type")
            .agg(F.count(F.lit(1)).alias("row_count")))


# --- A4 / A5 / A6 ----------------------------------------------------------------
def _ranked_sales_by(sales: DataFrame, key: str, file_id=None, top: int | None = 30) -> DataFrame:
    df = with_file(sales, file_id).filter(non_empty(key))
    out = df.groupBy(key).agg(*_totals(), F.countDistinct("product_code").alias("product_count"))
    if top is None:
        return out
    return out.orderBy(F.col("net_sales").desc_nulls_last(), F.col(key).asc()).limit(top)


def sales_by_supplier(sales: DataFrame, file_id=None, top: int | None = 30) -> DataFrame:
    """A4: net sales, quantity and distinct products per supplier; top 30.

    Ties on net sales are broken by supplier name.
    """
    return _ranked_sales_by(sales, "supplier", file_id, top)


def sales_by_category(sales: DataFrame, file_id=None, top: int | None = 30) -> DataFrame:
    """A5: the same per category."""
    return _ranked_sales_by(sales, "category", file_id, top)


def top_products(sales: DataFrame, file_id=None, top: int = 100, by: str = "code_name") -> DataFrame:
    """Best sellers, top 100 by net sales.

    ``by='code_name'`` groups by (product_code, product_name), null codes
    included (the SQL form); ``by='code'`` groups by a non-empty
    product_code only (the other form), the name then being an attribute.
    Attributes that are not grouping keys come from an arbitrary row in the
    source; here the smallest value is taken so the answer is deterministic.
    """
    df = with_file(sales, file_id)
    if by == "code":
        df = df.filter(non_empty("product_code"))
        keys, attrs = ["product_code"], ["product_name", "classification", "supplier", "category"]
    else:
        keys, attrs = ["product_code", "product_name"], ["classification", "supplier", "category"]
    out = df.groupBy(*keys).agg(*[F.min(a).alias(a) for a in attrs], *_totals())
    return out.orderBy(F.col("net_sales").desc_nulls_last(),
                       *[F.col(k).asc_nulls_first() for k in keys]).limit(top)


# --- A7 / A8 / A9 / A10 ---------------------------------------------------------------
def _dated(store_sales, file_id, start_date, end_date):
    df = with_dates(with_file(store_sales, file_id), start_date, end_date)
    return df.filter(F.col("sale_date").isNotNull())


def daily_sales(store_sales: DataFrame, file_id=None, start_date=None, end_date=None) -> DataFrame:
    """Net sales, quantity and rows per day, in date order."""
    df = _dated(store_sales, file_id, start_date, end_date)
    return (df.groupBy("sale_date").agg(*_totals(), F.count(F.lit(1)).alias("row_count"))
            .orderBy("sale_date"))


def weekly_sales(store_sales: DataFrame, file_id=None, start_date=None, end_date=None,
                 week_mode: str = "monday") -> DataFrame:
    """Per week: first and last day, net sales, quantity, rows, stores.

    The label is ``YYYY-Www`` with the calendar year; ``week_mode='monday'``
    numbers weeks from the first Monday (``%W`` + 1), ``'iso'`` uses ISO
    week numbers (still with the calendar year).
    """
    df = _dated(store_sales, file_id, start_date, end_date)
    # grouped by an integer; the label is made once per week
    return (df.groupBy(week_number("sale_date", week_mode).alias("_week"))
            .agg(F.min("sale_date").alias("start_date"), F.max("sale_date").alias("end_date"),
                 *_totals(), F.count(F.lit(1)).alias("row_count"),
                 F.countDistinct("store").alias("store_count"))
            .select(week_label("start_date", week_mode).alias("week"), "*").drop("_week")
            .orderBy("week"))


def monthly_sales(store_sales: DataFrame, file_id=None, start_date=None, end_date=None) -> DataFrame:
    """Per ``YYYY-MM``: net sales, quantity, rows, distinct stores."""
    df = _dated(store_sales, file_id, start_date, end_date)
    return (df.groupBy((F.year("sale_date") * 12 + F.month("sale_date")).alias("_month"))
            .agg(F.min("sale_date").alias("_day"), *_totals(), F.count(F.lit(1)).alias("row_count"),
                 F.countDistinct("store").alias("store_count"))
            .select(month_key("_day").alias("month"), "*").drop("_month", "_day")
            .orderBy("month"))


def store_sales_top(store_sales: DataFrame, file_id=None, start_date=None, end_date=None,
                    top: int | None = 30) -> DataFrame:
    """A10: net sales, quantity and rows per store; top 30 by net sales."""
    df = with_dates(with_file(store_sales, file_id), start_date, end_date).filter(non_empty("store"))
    out = df.groupBy("store").agg(*_totals(), F.count(F.lit(1)).alias("row_count"))
    if top is None:
        return out
    return out.orderBy(F.col("net_sales").desc_nulls_last(), F.col("store").asc()).limit(top)


# --- A13 / A14 ---------------------------------------------------------------------
def available_years(store_sales: DataFrame) -> DataFrame:
    """Distinct sale years, newest first."""
    return (store_sales.filter(F.col("sale_date").isNotNull())
            .select(F.year("sale_date").alias("year")).distinct().orderBy(F.col("year").desc()))


def data_counts(**tables: DataFrame) -> DataFrame:
    """One ``(table_name, row_count)`` row per given table (0 when empty)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
