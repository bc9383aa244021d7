"""Summaries that answer KPI, top-list and series questions without the lines.

A summary has a row per file (and day, for store lines) with the sums, and for
every distinct count the set of what is counted: values are coded by dense
numbers, kept in a dictionary, and a set is a bitmap per 32768 numbers. Bitmaps
of files and days are united exactly, so a week's stores or all files' products
are counted right whatever the files share.

Summaries are partitioned as the fact tables are, and deleting a file or a year
drops its partitions here too (``maintain.delete_file``, ``delete_year``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import month_key, week_label, week_number
from ..schemas import SALES_SCHEMA, STORE_SALES_SCHEMA
from ..sources.row_ids import with_row_ids
from ..sources.store import TableStore
from . import maintain as M
from .sales import money

_KINDS = {"file_id": T.IntegerType(), "sale_year": T.IntegerType(), "sale_date": T.DateType(), "net": T.DecimalType(38, 4),
          "qty": T.DoubleType(), "row_count": T.LongType(), "bucket": T.LongType(), "members": T.BinaryType(), "code": T.LongType()}


def _schema(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in names.split()])


DAY_SUMS = _schema("file_id sale_year sale_date net qty row_count")
DAY_STORES = _schema("file_id sale_year sale_date bucket members")
KEY_SUMS = _schema("file_id kind key net qty row_count")
KEY_SETS = _schema("file_id kind key counted bucket members")
CODES = _schema("code kind value")
SCHEMAS = {"day_sums": DAY_SUMS, "day_stores": DAY_STORES, "key_sums": KEY_SUMS, "key_sets": KEY_SETS}


def _sums(net: str = "net_sales", qty: str = "sold_qty") -> list[Column]:
    return [F.sum(net).cast("decimal(38,4)").alias("net"), F.sum(qty).alias("qty"), F.count(F.lit(1)).alias("row_count")]


def _set(code: str) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("members")


def _codes(store: TableStore, df: DataFrame, kinds: list[str]) -> DataFrame:
    """The dictionary, in which the values of the columns ``kinds`` that were
    not there yet have the next numbers."""
    values = None
    for kind in kinds:
        mine = df.select(F.lit(kind).alias("kind"), F.col(kind).alias("value")).filter("value is not null").distinct()
        values = mine if values is None else values.unionByName(mine)
    with store.claims.turn("codes"):
        known = store.read("codes", CODES)
        fresh, n = with_row_ids(store, "codes", values.join(known.select("kind", "value"), ["kind", "value"], "left_anti"))
        if n:
            store.append("codes", fresh.select(F.col("id").alias("code"), "kind", "value"), ["kind"])
        return store.read("codes", CODES)


def _coded(codes: DataFrame, df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the numbers of a column's values as ``code``; rows without
    a value are left out."""
    return df.join(codes.filter(F.col("kind") == kind).select(F.col("value").alias(kind), "code"), kind)


def summarise_files(store: TableStore, file_ids: list[int]) -> None:
    """(Re)writes the summaries of these files from the fact tables; the
    partitions of other files are not read. Sums are made of the lines as they
    are; only what is counted meets the dictionary."""
    ids = store.spark.createDataFrame([(int(f),) for f in file_ids], "value int")
    mine = F.col("file_id").isin([int(f) for f in file_ids])
    days = store.read(M.STORE_SALES, STORE_SALES_SCHEMA, mine)
    day = ["file_id", F.year("sale_date").alias("sale_year"), "sale_date"]
    put = lambda name, df, parts: store.replace_partitions(name, df.select(*SCHEMAS[name].fieldNames()), "file_id", ids, parts)
    put("day_sums", days.groupBy(*day).agg(*_sums()), ["file_id", "sale_year"])
    bucket = F.bitmap_bucket_number("code").alias("bucket")
    held = _coded(_codes(store, days, ["store"]), days.select("file_id", "sale_date", "store"), "store")
    put("day_stores", held.groupBy(*day, bucket).agg(_set("code")), ["file_id", "sale_year"])

    sales = store.read(M.SALES, SALES_SCHEMA, mine)
    # of every line its file's total, its supplier's and its category's
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (
        ("all", F.lit(None).cast("string")), ("supplier", F.col("supplier")), ("category", F.col("category")))]))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("k", each).filter("k.kind = 'all' or k.key is not null").select("*", "k.kind", "k.key")

    put("key_sums", keyed(sales).groupBy("file_id", "kind", "key").agg(*_sums()), ["file_id"])
    codes = _codes(store, sales, ["product_code", "supplier", "category"])
    columns = ("file_id", "kind", "key", "counted", "code")
    products = sales.select("file_id", "product_code", "supplier", "category")
    sets = keyed(_coded(codes, products, "product_code")).withColumn("counted", F.lit("product_code")).select(*columns)
    for kind in ("supplier", "category"):  # counted in whole files only
        some = _coded(codes, sales.select("file_id", kind).distinct(), kind)
        sets = sets.unionByName(some.select("file_id", F.lit("all").alias("kind"), F.lit(None).cast("string").alias("key"),
                                            F.lit(kind).alias("counted"), "code"))
    put("key_sets", sets.groupBy("file_id", "kind", "key", "counted", bucket).agg(_set("code")), ["file_id"])


def _size(df: DataFrame, *by: str) -> DataFrame:
    """Size of the united sets per group, as ``size``."""
    united = df.groupBy(*by, "bucket").agg(F.bitmap_or_agg("members").alias("members"))
    return united.groupBy(*by).agg(F.sum(F.bitmap_count("members")).alias("size"))


def _read(store: TableStore, table: str, file_id: int | None) -> DataFrame:
    return store.read(table, SCHEMAS[table], None if file_id is None else F.col("file_id") == int(file_id))


def summary_stats(store: TableStore, file_id: int | None = None) -> DataFrame:
    """A1 from the summaries."""
    all_ = F.col("kind") == "all"
    sums = _read(store, "key_sums", file_id).filter(all_).select("row_count", "net", "qty")
    sizes = _size(_read(store, "key_sets", file_id).filter(all_), "counted")
    n = lambda c: F.coalesce(F.max(F.when(F.col("counted") == c, F.col("size"))), F.lit(0))
    # one row of both: a row per file with sums, and one per kind with a size
    return sums.unionByName(sizes, allowMissingColumns=True).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_records"), money(F.sum("net")).alias("total_sales"),
        F.sum("qty").alias("total_qty"), n("product_code").alias("unique_products"),
        n("supplier").alias("unique_suppliers"), n("category").alias("unique_categories"))


def sales_by(store: TableStore, kind: str, file_id: int | None = None, top: int | None = 30) -> DataFrame:
    """A4 (``kind`` supplier) and A5 (category) from the summaries."""
    mine = (F.col("kind") == kind) & (F.col("key") != "")
    sums = _read(store, "key_sums", file_id).filter(mine).groupBy("key").agg(
        money(F.sum("net")).alias("net_sales"), F.sum("qty").alias("sold_qty"))
    sizes = _size(_read(store, "key_sets", file_id).filter(mine), "key")
    out = sums.join(sizes, "key", "left").select(F.col("key").alias(kind), "net_sales", "sold_qty",
                                                 F.coalesce("size", F.lit(0)).alias("product_count"))
    return out if top is None else out.orderBy(F.col("net_sales").desc_nulls_last(), F.col(kind).asc()).limit(top)


def _series(store: TableStore, file_id: int | None, group: Column) -> DataFrame:
    dated = F.col("sale_date").isNotNull()
    sums = _read(store, "day_sums", file_id).filter(dated).groupBy(group.alias("_group")).agg(
        F.min("sale_date").alias("start_date"), F.max("sale_date").alias("end_date"),
        money(F.sum("net")).alias("net_sales"), F.sum("qty").alias("sold_qty"), F.sum("row_count").alias("row_count"))
    sizes = _size(_read(store, "day_stores", file_id).filter(dated).withColumn("_group", group), "_group")
    return sums.join(sizes, "_group", "left").withColumn("store_count", F.coalesce("size", F.lit(0))).drop("_group", "size")


def weekly_sales(store: TableStore, file_id: int | None = None, week_mode: str = "monday") -> DataFrame:
    """A8 from the summaries."""
    out = _series(store, file_id, week_number("sale_date", week_mode))
    return out.select(week_label("start_date", week_mode).alias("week"), "*").orderBy("week")


def monthly_sales(store: TableStore, file_id: int | None = None) -> DataFrame:
    """A9 from the summaries."""
    out = _series(store, file_id, F.year("sale_date") * 12 + F.month("sale_date"))
    return out.select(month_key("start_date").alias("month"), "net_sales", "sold_qty", "row_count", "store_count").orderBy("month")
