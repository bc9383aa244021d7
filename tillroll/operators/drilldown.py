"""Multi-level drill-downs (H1-H3) as flat DataFrames.

The source builds nested dicts in a Python loop and truncates each level by
sorting lists. Here each level is its own partial aggregate, so no single task
ever holds a whole supplier or store. The leaves of H1 are shuffled by
(supplier, category) once: groups, their ranks and the category's totals are
windows and aggregates over that layout. Per-group top-N is a rank over a
window, which Spark plans as a WindowGroupLimit.

Output is one row per kept leaf carrying the totals of every level above it;
all level totals are taken before truncation, as in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import base_product_code, group_display_name, option_label, ustrip
from ..schemas import OTHER_LABEL
from .sales import with_file


def _leaf(df: DataFrame, keys: list[str]) -> DataFrame:
    """Leaf sums; a null sum counts as 0 (as ``float(x or 0)`` does)."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum("net_sales"), F.lit(0).cast("decimal(28,4)")).alias("net"),
        F.coalesce(F.sum("sold_qty"), F.lit(0.0)).alias("qty"))


def _category_keys(keep_null_category: bool) -> list[str]:
    return ["supplier"] + (["_ck", "_cn"] if keep_null_category else ["category"])


def _in_top_groups(leaf: DataFrame, keys: list[str], top_groups: int, **group: Column) -> DataFrame:
    """The leaves of the ``top_groups`` best groups of each category, with
    ``group_total``, ``group_rank`` and the aggregates ``group`` of their
    group; where the leaves are, without a shuffle."""
    one = Window.partitionBy(*keys, "base_code")
    df = leaf.select("*", F.sum("net").over(one).alias("group_total"), *[c.over(one).alias(n) for n, c in group.items()])
    w = Window.partitionBy(*keys).orderBy(F.col("group_total").desc(), F.col("base_code").asc())
    return df.withColumn("group_rank", F.dense_rank().over(w)).filter(F.col("group_rank") <= top_groups)


def supplier_category_leaves(sales: DataFrame, file_id=None,
                             keep_null_category: bool = False) -> DataFrame:
    """Leaf level of H1: sums per (supplier, category, code, name) with the
    product-group key, option label and group-name candidate attached."""
    keep = F.col("supplier").isNotNull()
    if not keep_null_category:
        keep = keep & F.col("category").isNotNull()
    df = with_file(sales, file_id).filter(keep)
    leaf = _leaf(df, ["supplier", "category", "product_code", "product_name"])
    if keep_null_category:
        # null-safe join keys for the category: its text and a null flag
        leaf = (leaf.withColumn("_ck", F.coalesce(F.col("category"), F.lit("")))
                .withColumn("_cn", F.col("category").isNull()))
    # the one shuffle of the leaves: their groups, ranks and totals are all
    # made inside a category of a supplier
    leaf = leaf.repartition(*_category_keys(keep_null_category))
    # the stripped name is computed once and shared by C3 and C4
    leaf = leaf.withColumn("_n", ustrip("product_name"))
    base = F.coalesce(base_product_code("product_name", stripped="_n"),
                      F.nullif(F.col("product_code"), F.lit("")), F.lit(OTHER_LABEL))
    return (leaf.withColumn("base_code", base)
            .withColumn("option_name", option_label("product_name", "base_code", stripped="_n"))
            .withColumn("_rep", group_display_name("product_name"))
            .drop("_n"))


def supplier_category_matrix(sales: DataFrame, file_id=None, top_groups: int = 50,
                             keep_null_category: bool = False) -> DataFrame:
    """H1: supplier -> category -> product group -> option, flat.

    * product group = base code of the name (C3), else the product code,
      else the "other" label; option label from C4;
    * group name (C6) taken from the best-selling option whose C6 name is
      non-empty (ties: smaller code, then name);
    * supplier, category and group totals over all rows; only the top
      ``top_groups`` groups per (supplier, category) by net sales are kept
      (ties: base code);
    * one output row per option of a kept group.

    Rows without a category are left out (the SQL form);
    ``keep_null_category=True`` keeps them as their own category (the other
    form of the source), joined null-safely.
    """
    leaf = supplier_category_leaves(sales, file_id, keep_null_category)
    keys = _category_keys(keep_null_category)
    pick = F.when(F.col("_rep") != "", F.struct(-F.col("net"), F.col("product_code"),
                                                F.col("product_name")))
    kept = _in_top_groups(leaf, keys, top_groups, group_qty=F.sum("qty"), option_count=F.count(F.lit(1)),
                          group_name=F.min_by("_rep", pick))
    # category and supplier totals straight from the leaves (exact decimal
    # sums), joined at category level. The counts (always true) read the other
    # columns, which keeps the leaves the same on both sides of the join, so
    # that they are made and shuffled once
    cats = leaf.groupBy(*keys).agg(
        F.sum("net").alias("category_total"), F.sum("qty").alias("category_qty"),
        (F.count("category") + F.count("product_code") + F.count("product_name")).alias("_read")).filter("_read >= 0").drop("_read")
    sups = cats.groupBy("supplier").agg(
        F.sum("category_total").alias("supplier_total"), F.sum("category_qty").alias("supplier_qty"))
    out = kept.join(cats.join(sups, "supplier"), keys).withColumn("group_name", F.coalesce("group_name", F.lit("")))
    return out.select(
        "supplier", F.col("supplier_total").cast("double").alias("supplier_total"), "supplier_qty",
        "category", F.col("category_total").cast("double").alias("category_total"), "category_qty",
        "base_code", "group_name", F.col("group_total").cast("double").alias("group_total"),
        "group_qty", "option_count", F.col("group_rank").cast("long").alias("group_rank"),
        "product_code", "product_name", "option_name",
        F.col("net").cast("double").alias("net_sales"), F.col("qty").alias("sold_qty"))


def matrix_order(flat: DataFrame) -> DataFrame:
    """Presentation order of H1 rows: suppliers, categories, groups, options
    by net sales descending (a global range-partitioned sort)."""
    return flat.orderBy(F.col("supplier_total").desc(), "supplier", F.col("category_total").desc(),
                        "category", "group_rank", F.col("net_sales").desc(), "product_code",
                        "product_name")


def matrix_export(sales: DataFrame, file_id=None, top_groups: int = 50) -> DataFrame:
    """H3: export rows (supplier, category, code, name, net, qty) of the
    options of H1's kept groups, from the leaves alone."""
    leaf = supplier_category_leaves(sales, file_id).select("supplier", "category", "base_code", "product_code",
                                                           "product_name", "net", "qty")
    return _in_top_groups(leaf, _category_keys(False), top_groups).select(
        "supplier", "category", "product_code", "product_name",
        F.col("net").cast("double").alias("net_sales"), F.col("qty").alias("sold_qty"))


def flatten_matrix(flat: DataFrame) -> DataFrame:
    """H3: export rows (supplier, category, code, name, net, qty) of H1."""
    return flat.select("supplier", "category", "product_code", "product_name", "net_sales",
                       "sold_qty")


def store_category_matrix(store_sales: DataFrame, file_id=None, top_stores: int = 50,
                          top_products: int = 15) -> DataFrame:
    """H2: store -> classification -> product, flat.

    Leaves are sums per (store, classification, code, name) with both keys
    non-null; an empty classification is shown as the "other" label. Only
    the top ``top_stores`` stores by net sales are kept (ties: store name),
    with all their classifications and the top ``top_products`` products of
    each (ties: code, then name). Totals are taken before truncation.
    """
    df = with_file(store_sales, file_id).filter(F.col("store").isNotNull()
                                                & F.col("classification").isNotNull())
    leaf = (_leaf(df, ["store", "classification", "product_code", "product_name"])
            .withColumn("category", F.when(F.col("classification") == "", F.lit(OTHER_LABEL))
                        .otherwise(F.col("classification"))))
    cats = leaf.groupBy("store", "category").agg(F.sum("net").alias("category_total"),
                                                 F.sum("qty").alias("category_qty"))
    stores = cats.groupBy("store").agg(F.sum("category_total").alias("store_total"),
                                       F.sum("category_qty").alias("store_qty"))
    # at most top_stores rows: a proven bound, so broadcasting it is safe
    # (the sums are never null; reading both in every branch keeps the leaf
    # aggregate the same everywhere, so that it is made once)
    stores = stores.filter("store_total is not null and store_qty is not null")
    best = stores.orderBy(F.col("store_total").desc(), F.col("store").asc()).limit(top_stores)
    best = best.withColumn("store_rank", F.row_number().over(
        Window.orderBy(F.col("store_total").desc(), F.col("store").asc())))
    kept_leaf = leaf.join(F.broadcast(best.select("store")), "store")
    w = Window.partitionBy("store", "category").orderBy(
        F.col("net").desc(), F.col("product_code").asc_nulls_first(),
        F.col("product_name").asc_nulls_first())
    ranked = (kept_leaf.withColumn("product_rank", F.row_number().over(w))
              .filter(F.col("product_rank") <= top_products))
    kept_cats = cats.join(F.broadcast(best), "store")
    out = ranked.join(kept_cats, ["store", "category"])
    return out.select(
        "store", F.col("store_total").cast("double").alias("store_total"), "store_qty",
        F.col("store_rank").cast("long").alias("store_rank"),
        "category", F.col("category_total").cast("double").alias("category_total"), "category_qty",
        F.col("product_rank").cast("long").alias("product_rank"), "product_code", "product_name",
        F.col("net").cast("double").alias("net_sales"), F.col("qty").alias("sold_qty"))


def store_category_tree(flat: DataFrame) -> DataFrame:
    """H2 as nested rows: one row per kept store with its classifications,
    each holding its (at most ``top_products``) products.

    Every list is bounded by the cuts already applied to ``flat`` (top
    products per classification; classifications per store are the distinct
    classification values, not rows), so no group grows with the data.
    """
    product = F.struct(F.col("product_rank").alias("rank"), "product_code", "product_name",
                       "net_sales", "sold_qty")
    cats = (flat.groupBy("store", "store_total", "store_qty", "store_rank", "category",
                         "category_total", "category_qty")
            .agg(F.array_sort(F.collect_list(product)).alias("products")))
    cat = F.struct(F.negative(F.col("category_total")).alias("_order"),
                   F.col("category").alias("category"), F.col("category_total").alias("total"),
                   F.col("category_qty").alias("total_qty"), "products")
    return (cats.groupBy("store", "store_total", "store_qty", "store_rank")
            .agg(F.array_sort(F.collect_list(cat)).alias("_cats"))
            .select("store_rank", "store", F.col("store_total").alias("total"),
                    F.col("store_qty").alias("total_qty"),
                    F.transform("_cats", lambda c: c.dropFields("_order")).alias("categories"))
            .orderBy("store_rank"))
