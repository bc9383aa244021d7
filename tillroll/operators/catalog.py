"""Product catalog (image mapping) operators and the catalog-stock join.

Catalog rows map a supplier option to a product code, name, barcode and
image address. Grouping by product code (A11) de-duplicates options with a
partial ``collect_set`` (map-side de-dup), so the final list per code is the
distinct options only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import catalog_tags


def _lower_contains(c: str, keyword: str) -> Column:
    # literal substring match, case-insensitive; "%" and "_" are not wildcards
    return F.coalesce(F.lower(F.col(c)).contains(keyword.lower()), F.lit(False))


def _first(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row in a fixed column order (the source's "first row")."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(1)


# --- A11 / A15 ---------------------------------------------------------------------
def catalog_groups(images: DataFrame) -> DataFrame:
    """Catalog grouped by product code.

    Smallest name, distinct options joined by "," in sorted order (null when
    there are none), smallest image address and the number of catalog rows.
    Ordered by name (nulls first), then code.
    """
    opts = F.array_sort(F.collect_set("supplier_option"))
    out = images.groupBy("product_code").agg(
        F.min("product_name").alias("product_name"),
        F.when(F.size(opts) > 0, F.array_join(opts, ",")).alias("supplier_option"),
        F.min("image_url").alias("image_url"),
        F.count(F.lit(1)).alias("option_count"))
    return out.orderBy(F.col("product_name").asc_nulls_first(), F.col("product_code").asc_nulls_first())


def catalog_listing(images: DataFrame) -> DataFrame:
    """A11, the other form of the source: per product code, the rows in
    name order; name and image address from the first row, and options
    joined by ", " in that order, each added only when it is not already a
    substring of the text so far. ``option_count`` counts all rows.

    The ordered fold is Spark's ``aggregate`` higher-order function over the
    code's different options (JVM-side, no UDF): a repeated option adds
    nothing after its first row, so only that one is gathered.
    """
    row = F.struct("product_name", "supplier_option", "image_url")
    each = images.groupBy("product_code", "supplier_option").agg(F.min(row).alias("_row"), F.count(F.lit(1)).alias("_n"))
    g = each.groupBy("product_code").agg(F.array_sort(F.collect_list("_row")).alias("_rows"),
                                         F.sum("_n").alias("option_count"))
    first = F.col("_rows")[0]

    def add(acc, x):
        o = x["supplier_option"]
        skip = o.isNull() | (o == "") | F.coalesce(acc, F.lit("")).contains(o)
        return F.when(skip, acc).otherwise(F.concat_ws(", ", acc, o))

    opts = F.aggregate(F.slice("_rows", 2, F.size("_rows")), first["supplier_option"], add)
    return g.select("product_code", first["product_name"].alias("product_name"),
                    opts.alias("supplier_option"), first["image_url"].alias("image_url"),
                    "option_count")


def catalog_count(images: DataFrame) -> DataFrame:
    """Number of catalog rows."""
    return images.agg(F.count(F.lit(1)).alias("row_count"))


# --- F5 / F8 / F9 / F14 ------------------------------------------------------------
def search_catalog(images: DataFrame, keyword: str, top: int = 100) -> DataFrame:
    """catalog groups of rows whose name contains ``keyword``; first 100 by
    name. An empty keyword gives no rows."""
    if not keyword:
        return catalog_groups(images).limit(0)
    return catalog_groups(images.filter(_lower_contains("product_name", keyword))).limit(top)


def image_by_option(images: DataFrame, supplier_option: str) -> DataFrame:
    """F8: the catalog row of one supplier option (first by code, name)."""
    if not supplier_option:
        return images.limit(0)
    return _first(images.filter(F.col("supplier_option") == supplier_option),
                  ["product_code", "product_name", "barcode", "image_url"])


def image_by_code(images: DataFrame, product_code: str) -> DataFrame:
    """the catalog row of one product code (first by option, name)."""
    if not product_code:
        return images.limit(0)
    return _first(images.filter(F.col("product_code") == str(product_code)),
                  ["supplier_option", "product_name", "barcode", "image_url"])


def catalog_list(images: DataFrame, keyword: str | None = None) -> DataFrame:
    """search when a keyword is given, else the whole grouped catalog."""
    return search_catalog(images, keyword) if keyword else catalog_groups(images)


def image_lookup(images: DataFrame, supplier_option: str | None = None,
                 product_code: str | None = None) -> DataFrame:
    """single image by supplier option, else by product code."""
    if supplier_option:
        return image_by_option(images, supplier_option)
    return image_by_code(images, product_code)


# --- C21 / F11 / F12 ------------------------------------------------------------------
def with_tags(groups: DataFrame, other: str = "all") -> DataFrame:
    """Add the ``tags`` array (top / bottom / accessory / other)."""
    return groups.withColumn("tags", catalog_tags("product_name", "product_code", other))


def catalog_find(groups: DataFrame, keyword: str) -> DataFrame:
    """grouped catalog rows whose name or code contains the keyword
    (trimmed, lower-cased); the tab filter is ignored, as on the page."""
    k = (keyword or "").strip().lower()
    if not k:
        return groups
    return groups.filter(_lower_contains("product_name", k) | _lower_contains("product_code", k))


def catalog_tab(groups: DataFrame, tag: str, other: str = "all") -> DataFrame:
    """grouped catalog rows in one tab; ``'all'`` keeps everything."""
    if tag == "all":
        return groups
    return groups.filter(F.array_contains(catalog_tags("product_name", "product_code", other), tag))


# --- J1 / J2 / J3 ------------------------------------------------------------------------
def one_stock_row(inventory: DataFrame) -> DataFrame:
    """One stock row per supplier option: the largest (normal, available)
    pair. A partial aggregate, so a hot option costs one row per task."""
    best = F.max(F.struct("normal_stock", "available_stock")).alias("_s")
    return (inventory.groupBy("supplier_option").agg(best)
            .select("supplier_option", "_s.normal_stock", "_s.available_stock"))


def product_options_with_stock(images: DataFrame, inventory: DataFrame,
                               product_code: str | None = None,
                               one_per_option: bool = False) -> DataFrame:
    """Catalog options with their stock (missing stock -> 0).

    ``product_code`` limits the answer to one product; None answers every
    product at once and needs ``one_per_option=True`` (J2), which joins at
    most one stock row per option, so the join never multiplies rows. The
    default (J1) joins every matching stock row of one product's options, as
    a plain LEFT JOIN does.
    """
    if product_code is None and not one_per_option:
        raise ValueError("all products at once need one_per_option=True")
    pi = images
    if product_code is not None:
        pi = pi.filter(F.col("product_code") == str(product_code))
    stock = (one_stock_row(inventory) if one_per_option
             else inventory.select("supplier_option", "normal_stock", "available_stock"))
    out = pi.join(stock, "supplier_option", "left").select(
        "product_code", "supplier_option", "product_name", "barcode",
        F.coalesce("normal_stock", F.lit(0)).alias("normal_stock"),
        F.coalesce("available_stock", F.lit(0)).alias("available_stock"))
    return out.orderBy("product_code", "supplier_option")


def option_rollup(options: DataFrame) -> DataFrame:
    """Per product: option count, total stock, sold-out options."""
    stock = F.coalesce(F.col("normal_stock"), F.lit(0))
    return options.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("option_count"),
        F.sum(stock).cast("long").alias("total_stock"),
        F.count(F.when(stock == 0, F.lit(1))).alias("soldout_options"))
