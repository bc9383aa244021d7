"""Stock (inventory) operators: summary, lists, search, low stock, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import stock_status


def inventory_summary(inventory: DataFrame, out_of_stock: str = "zero") -> DataFrame:
    """Rows, in stock (>0), out of stock, stock sums.

    ``out_of_stock='zero'`` counts exactly 0 (the SQL form; negative or null
    stock is in neither count); ``'not_in_stock'`` counts every row that is
    not in stock (the other form of the source).
    """
    n = F.col("normal_stock")
    out = (n == 0) if out_of_stock == "zero" else ~F.coalesce(n > 0, F.lit(False))
    return inventory.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count(F.when(n > 0, F.lit(1))).alias("in_stock"),
        F.count(F.when(out, F.lit(1))).alias("out_of_stock"),
        F.sum(n).cast("long").alias("total_normal_stock"),
        F.sum("available_stock").cast("long").alias("total_available_stock"))


def _by_stock_desc(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("normal_stock").desc_nulls_last(), F.col("product_code").asc_nulls_first(),
                      F.col("supplier_option").asc_nulls_first(), F.col("product_name").asc_nulls_first())


def all_inventory(inventory: DataFrame, limit: int | None = None) -> DataFrame:
    """O2: the whole stock list by stock, highest first; optional limit."""
    out = _by_stock_desc(inventory)
    return out.limit(limit) if limit else out


def search_inventory(inventory: DataFrame, keyword: str, top: int = 100) -> DataFrame:
    """stock rows whose name contains the keyword; 100 by stock desc."""
    if not keyword:
        return inventory.limit(0)
    hit = F.coalesce(F.lower(F.col("product_name")).contains(keyword.lower()), F.lit(False))
    return _by_stock_desc(inventory.filter(hit)).limit(top)


def low_stock(inventory: DataFrame, threshold: int = 10) -> DataFrame:
    """rows with ``0 < normal_stock <= threshold``, lowest first."""
    n = F.col("normal_stock")
    return (inventory.filter((n > 0) & (n <= threshold))
            .orderBy(n.asc(), F.col("product_code").asc_nulls_first(),
                     F.col("supplier_option").asc_nulls_first(),
                     F.col("product_name").asc_nulls_first()))


def inventory_by_option(inventory: DataFrame, supplier_option: str) -> DataFrame:
    """the stock row of one supplier option (first by code, name)."""
    if not supplier_option:
        return inventory.limit(0)
    return (inventory.filter(F.col("supplier_option") == supplier_option)
            .orderBy(F.col("product_code").asc_nulls_first(), F.col("product_name").asc_nulls_first(),
                     F.col("normal_stock").desc_nulls_last()).limit(1))


def inventory_list(inventory: DataFrame, keyword: str | None = None, low: bool = False,
                   threshold: int = 10, limit: int | None = None) -> DataFrame:
    """search when a keyword is given, else low stock, else everything."""
    if keyword:
        return search_inventory(inventory, keyword)
    if low:
        return low_stock(inventory, threshold)
    return all_inventory(inventory, limit)


def with_stock_status(inventory: DataFrame) -> DataFrame:
    """Add the stock status label (normal / low / sold out)."""
    return inventory.withColumn("stock_status", stock_status("normal_stock"))
