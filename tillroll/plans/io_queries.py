"""Registered source / sink / maintenance queries (S1, S3, S7, S11-S14,
T1, T4, T5). Each writes through the library to a fresh folder under the
session's shared checkpoint folder and returns the table read back, so the
oracle is the expected table content."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog as K, maintain as M, sales as S, summary as SM
from ..schemas import (CHUNK_SCHEMA, FILES_SCHEMA, INVENTORY_SCHEMA, PRODUCT_IMAGES_SCHEMA, SALES_SCHEMA,
                       STORE_SALES_SCHEMA)
from ..session import work_path
from ..sources import export as X, ingest as G, snapshots as SN
from ..sources.delimited import read_records
from ..sources.postings import SearchIndex
from ..sources.row_ids import stored_schema
from ..sources.store import TableStore
from ..streaming import chunks as CH
from ..streaming.expiry import run_expiry
from . import catalog_queries, duck_sql as Q, sales_queries  # noqa: F401 (their SQL is used again)
from .clean_queries import (CLEAN_CATALOG_SQL, CLEAN_INVENTORY_SQL, CLEAN_SALES_SQL, CLEAN_STORE_SQL,
                            SALES_TEXT, raw_catalog_file, raw_sales_file, raw_stock_file, raw_store_file)
from .registry import REGISTRY, query

def _chunked_upload(fx):
    """S3: sales lines sent as JSON chunks that carry no file id, loaded by
    the streaming job, which opens the file record and folds the file into
    the sales table once all its chunks are in. Returns the store."""
    spark = fx.spark
    # client chunk size: the lines of 2000 consecutive order keys (~8000 lines)
    lines = raw_sales_file(fx, F.floor(F.col("l_orderkey") / 2000).alias("_chunk"))
    root = work_path(spark, "chunk-upload")
    CH.write_chunks(lines, f"{root}/in", None, "original", "_chunk", list(SALES_TEXT), "export.xlsx")
    store = TableStore(spark)
    CH.run_chunk_upload(spark, f"{root}/in", f"{root}/tables", finalize_into=store)
    return store


@query("chunk_upload", views=("raw_lines",), sql=CLEAN_SALES_SQL)
def _s3(fx):
    """S3: sales lines sent as JSON chunks, read from the sales table."""
    return _chunked_upload(fx).read(M.SALES, SALES_SCHEMA)


@query("chunk_registry", views=("raw_lines",), sql=f"""
SELECT cast(1 AS integer) AS id, 'export.xlsx' AS original_name, 'original' AS file_type, count(*) AS row_count
FROM raw_lines WHERE {Q.keep_sales_line("product_name")}""")
def _s3r(fx):
    """S3 + T1 + T2: the file record that a chunked upload opens and counts."""
    return _chunked_upload(fx).read(M.FILES, FILES_SCHEMA).select("id", "original_name", "file_type", "row_count")


_CHUNK = "floor(l_orderkey / 1000)"


@query("upload_expiry", views=("raw_lines",), sql=f"""
SELECT file_id, status, coalesce(n, 0) AS fact_rows, coalesce(s, 0) AS staged_rows
FROM (VALUES (1, 'active'), (2, 'expired'), (3, 'active')) f(file_id, status)
LEFT JOIN (SELECT 1 AS file_id, count(*) AS n FROM raw_lines WHERE {Q.keep_store_line("store")}) USING (file_id)
LEFT JOIN (SELECT 3 AS file_id, count(*) AS s FROM raw_lines
  WHERE {Q.keep_store_line("store")} AND {_CHUNK} > 0) USING (file_id)""")
def _s3x(fx):
    """S3: a complete upload, one whose first chunk never came, and a recent
    one like it. A day later the first is closed and the second expired,
    neither leaves staged rows, and a chunk sent again for the second changes
    nothing."""
    spark, store = fx.spark, TableStore(fx.spark)
    headers = {"date_text": "판매일자", "store": "매장명", "product_name": "상품명", "qty_text": "판매량"}
    lines = fx.raw_lines.select(F.expr(_CHUNK).alias("_chunk"), *[F.col(k).alias(v) for k, v in headers.items()])
    root = work_path(spark, "upload-expiry")
    for fid, day, part in ((1, "2024-01-01", lines), (2, "2024-01-02", lines), (3, "2024-01-09", lines)):
        at = f"{root}/all/{fid}"
        CH.write_chunks(part, at, fid, "monthly", "_chunk", list(headers.values()), f"f{fid}.xlsx", "의류", day)
        docs = spark.read.schema(CHUNK_SCHEMA).json(at)
        CH.write_documents(docs if fid == 1 else docs.filter("chunk_index > 0"), f"{root}/in", "append")

    def go(name):
        paths = CH.run_chunk_upload(spark, f"{root}/in", f"{root}/tables", f"{root}/{name}", finalize_into=store)
        run_expiry(spark, f"{root}/in", paths, store, "1 day", f"{root}/{name}-ends")
        return paths

    go("ck")
    CH.write_documents(spark.read.schema(CHUNK_SCHEMA).json(f"{root}/all/2").filter("chunk_index = 0"), f"{root}/in", "append")
    paths = go("ck")
    facts = store.read(M.STORE_SALES, STORE_SALES_SCHEMA).groupBy("file_id").agg(F.count("*").alias("fact_rows"))
    staged = CH.staged_rows(spark, paths, "store_sales").groupBy("file_id").agg(F.count("*").alias("staged_rows"))
    files = store.read(M.FILES, FILES_SCHEMA).select(F.col("id").alias("file_id"), "status")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (files.join(facts, "file_id", "left").join(staged, "file_id", "left")
            .select("file_id", "status", none("fact_rows"), none("staged_rows")))


@query("store_chunk_upload", views=("raw_lines",), sql=CLEAN_STORE_SQL)
def _s3m(fx):
    """S3 for store/day chunks (file_type 'monthly', data type in the
    envelope, file id given), read from the store table."""
    spark = fx.spark
    hdr = {"date_text": "판매일자", "store": "매장명", "classification": "분류명",
           "product_name": "상품명", "qty_text": "판매량"}
    lines = fx.raw_lines.select(F.floor(F.col("l_orderkey") / 2000).alias("_chunk"),
                                *[F.col(k).alias(v) for k, v in hdr.items()])
    root = work_path(spark, "chunk-upload")
    CH.write_chunks(lines, f"{root}/in", 2, "monthly", "_chunk", list(hdr.values()),
                    data_type="의류")
    store = TableStore(spark)
    CH.run_chunk_upload(spark, f"{root}/in", f"{root}/tables", finalize_into=store)
    return store.read(M.STORE_SALES, STORE_SALES_SCHEMA)


# text files written only to be loaded: compressed, and bounded, as each is
# then read by one task
_PACKED = {"compression": "gzip", "maxRecordsPerFile": 500_000}
_CSV_RAW = ("(SELECT nullif(classification, '') AS classification, money_text, code_text, "
            "nullif(product_name, '') AS product_name, nullif(qty_text, '') AS qty_text "
            "FROM raw_lines) raw_csv")


@query("csv_load", views=("raw_lines",),
       sql=CLEAN_SALES_SQL.replace("FROM raw_lines", f"FROM {_CSV_RAW}"))
def _s1(fx):
    """S1 + T1 + S7: a sales export written as CSV, read back as text,
    registered as a file, cleaned and appended, then read from the table.
    (Empty CSV cells read as null, as in any CSV reader.)"""
    spark = fx.spark
    root = work_path(spark, "csv-load")
    (raw_sales_file(fx).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).options(**_PACKED).csv(f"{root}/export.csv"))
    store = TableStore(spark)
    raw = G.read_delimited(spark, f"{root}/export.csv")
    fid = M.register_file(store, "export.csv", "export.csv", "original")
    G.save_sales(store, raw, fid)
    return store.read(M.SALES, SALES_SCHEMA)


_NAMES = """CASE l_linenumber % 3 WHEN 0 THEN product_name || ' "q", ' || chr(10) || 'next' WHEN 1
  THEN '"' || product_name || '"' ELSE nullif(product_name, '') END"""


@query("csv_quoted", views=("raw_lines",), sql=f"""
SELECT l_orderkey, l_linenumber, {_NAMES} AS name, nullif(classification, '') AS classification FROM raw_lines""")
def _s1q(fx):
    """Cells with doubled quotes, separators and line breaks, exported by
    the library and read back split by split."""
    spark = fx.spark
    path = work_path(spark, "csv-quoted")
    lines = fx.raw_lines.select("l_orderkey", "l_linenumber", F.expr(_NAMES).alias("name"), "classification")
    X.export_dataset(lines, path)
    return G.read_delimited(spark, path).select(
        F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "name", "classification")


_LINE = """l_orderkey || ',' || l_linenumber || ',"' || replace(coalesce(product_name, ''), '"', '""') || '"'"""
_BAD = "CASE WHEN l_orderkey % 97 = 3 THEN ',one cell more' ELSE '' END"


@query("csv_rejected", views=("raw_lines",), sql=f"""
SELECT l_orderkey % 97 = 3 AS rejected, CASE WHEN l_orderkey % 97 = 3 THEN {_LINE} || {_BAD}
  ELSE concat_ws('|', l_orderkey, l_linenumber, nullif(product_name, '')) END AS content,
  CASE WHEN l_orderkey % 97 = 3 THEN 'more cells than the header' END AS reason FROM raw_lines""")
def _s1r(fx):
    """Records with a cell too many stand beside the accepted ones; both
    together are the lines written."""
    spark = fx.spark
    path = work_path(spark, "csv-rejected")
    fx.raw_lines.select(F.expr(f"{_LINE} || {_BAD}").alias("value")).write.text(path)
    found = read_records(spark, path, header=False, columns=["l_orderkey", "l_linenumber", "name"])
    good = found.accepted().select(F.lit(False).alias("rejected"), F.concat_ws("|", *found.header).alias("content"),
                                   F.lit(None).cast("string").alias("reason"))
    return good.unionByName(found.rejected().select(F.lit(True).alias("rejected"), F.col("record").alias("content"), "reason"))


@query("row_ids", views=("raw_lines",), sql=f"""
SELECT state, file_id, n AS row_count, (file_id - 1) * n + 1 AS first_id, file_id * n AS last_id, n AS ids, n AS dated
FROM (SELECT count(*) AS n FROM raw_lines WHERE {Q.keep_store_line("store")}),
  (VALUES ('loaded', 1), ('loaded', 2), ('restored', 1), ('restored', 2), ('loaded again', 3)) s(state, file_id)""")
def _s8i(fx):
    """S8 + S13 + S14: row ids and load times of store lines after two loads,
    after a restore into another store, and after a load there."""
    spark = fx.spark
    first, second = TableStore(spark), TableStore(spark)
    stored = stored_schema(STORE_SALES_SCHEMA)
    lines = raw_store_file(fx)
    for fid in (1, 2):
        G.save_store_sales(first, lines, fid)
    path = work_path(spark, "snapshot")
    X.snapshot(path, first.read(M.SALES, SALES_SCHEMA), first.read(M.STORE_SALES, stored))
    X.restore_snapshot(second, path)
    restored = second.read(M.STORE_SALES, stored)
    G.save_store_sales(second, lines, 3)
    again = second.read(M.STORE_SALES, stored).filter("file_id = 3")

    def summed(df, state):
        return df.groupBy("file_id").agg(
            F.count("*").alias("row_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
            F.countDistinct("id").alias("ids"), F.count("created_at").alias("dated")).withColumn("state", F.lit(state))

    return (summed(first.read(M.STORE_SALES, stored), "loaded").unionByName(summed(restored, "restored"))
            .unionByName(summed(again, "loaded again")))


def _full(schema, cols):
    return Q.typed_select(schema, {c: c for c in cols})


_SALES_COLS = ["file_id", "classification", "category", "supplier", "product_code",
               "product_name", "sold_qty", "cancel_qty", "net_sales"]
_STORE_COLS = ["file_id", "data_type", "sale_date", "store_code", "store", "classification",
               "product_code", "product_name", "sold_qty", "net_sales"]


@query("delete_year", views=("store_sales",), sql=f"""
SELECT {_full(STORE_SALES_SCHEMA, _STORE_COLS)} FROM store_sales
WHERE sale_date IS NULL OR year(sale_date) <> 1995""")
def _t5(fx):
    """T5: store table stored, one year's partitions dropped, read back."""
    store = TableStore(fx.spark)
    store.replace(M.STORE_SALES, G.store_layout(G.conform(fx.store_sales, STORE_SALES_SCHEMA)), G.STORE_PARTS)
    M.delete_year(store, 1995, valid_years=None)
    return store.read(M.STORE_SALES, STORE_SALES_SCHEMA)


@query("delete_then_append", views=("store_sales",), sql=f"""
SELECT {_full(STORE_SALES_SCHEMA, _STORE_COLS)} FROM store_sales
WHERE (file_id <> 2 AND (sale_date IS NULL OR year(sale_date) <> 1996)) OR (file_id = 2 AND year(sale_date) = 1996)""")
def _t45(fx):
    """T4 + T5 + S8: a file and a year deleted, then that file's lines of
    that year loaded again: only the new ones of either show."""
    store = TableStore(fx.spark)
    lines = G.conform(fx.store_sales, STORE_SALES_SCHEMA)
    store.replace(M.STORE_SALES, G.store_layout(lines), G.STORE_PARTS)
    M.delete_file(store, 2)
    M.delete_year(store, 1996, valid_years=None)
    again = lines.filter((F.col("file_id") == 2) & (F.year("sale_date") == 1996))
    store.append(M.STORE_SALES, G.store_layout(again), G.STORE_PARTS)
    return store.read(M.STORE_SALES, STORE_SALES_SCHEMA)


@query("delete_file", views=("sales",), sql=f"""
SELECT {_full(SALES_SCHEMA, _SALES_COLS)} FROM sales WHERE file_id <> 2""")
def _t4(fx):
    """T4: sales table stored, one file's lines deleted, read back."""
    spark = fx.spark
    store = TableStore(spark)
    store.replace(M.SALES, G.conform(fx.sales, SALES_SCHEMA), ["file_id"])
    M.delete_file(store, 2)
    return store.read(M.SALES, SALES_SCHEMA)


@query("restore_tables", views=("sales", "store_sales"), sql="""
SELECT 'sales' AS table_name, file_id, count(*) AS row_count, cast(sum(net_sales) AS double) AS net_sales,
  sum(sold_qty) AS sold_qty, NULL::DATE AS last_date FROM sales GROUP BY file_id
UNION ALL SELECT 'store_sales', file_id, count(*), cast(sum(net_sales) AS double), sum(sold_qty), max(sale_date)
FROM store_sales GROUP BY file_id
UNION ALL SELECT 'files', file_id, count(*), NULL, NULL, NULL FROM sales WHERE file_id <> 3 GROUP BY file_id""")
def _s14(fx):
    """S13 + S14: both fact tables and the registry written as a JSON
    snapshot, restored over other content, and read back from the store."""
    spark = fx.spark
    path = work_path(spark, "snapshot")
    counts = fx.sales.groupBy("file_id").agg(F.count("*").alias("row_count"))
    files = counts.select(F.col("file_id").alias("id"), F.lit("f").alias("filename"), F.lit("f").alias("original_name"),
                          F.lit("original").alias("file_type"), "row_count",
                          F.lit(None).cast("timestamp").alias("upload_date"),
                          F.when(F.col("file_id") == 3, "deleted").otherwise("active").alias("status"),
                          F.lit("memo").alias("data_period"))
    X.snapshot(path, G.conform(fx.sales, SALES_SCHEMA), G.conform(fx.store_sales, STORE_SALES_SCHEMA), files)
    store = TableStore(spark)
    M.register_file(store, "old", "old", "original")
    X.restore_snapshot(store, path)

    def summed(table, schema, day):
        return store.read(table, schema).groupBy("file_id").agg(
            F.count("*").alias("row_count"), F.sum("net_sales").cast("double").alias("net_sales"),
            F.sum("sold_qty").alias("sold_qty"), day.alias("last_date")).withColumn("table_name", F.lit(table))

    registry = store.read(M.FILES, FILES_SCHEMA)
    total = registry.select(F.col("id").alias("file_id"), "row_count", F.lit(None).cast("double").alias("net_sales"),
                            F.lit(None).cast("double").alias("sold_qty"), F.lit(None).cast("date").alias("last_date"),
                            F.lit("files").alias("table_name"))
    return (summed(M.SALES, SALES_SCHEMA, F.lit(None).cast("date"))
            .unionByName(summed(M.STORE_SALES, STORE_SALES_SCHEMA, F.max("sale_date"))).unionByName(total))


@query("snapshot_restore", views=("store_sales",), sql=f"""
SELECT {_full(STORE_SALES_SCHEMA, _STORE_COLS)} FROM store_sales""")
def _s13(fx):
    """S13 + S14: tables written as a JSON snapshot, restored into a table
    store, the store lines read from it."""
    spark = fx.spark
    path = work_path(spark, "snapshot")
    X.snapshot(path, G.conform(fx.sales, SALES_SCHEMA),
               G.conform(fx.store_sales, STORE_SALES_SCHEMA))
    store = TableStore(spark)
    X.restore_snapshot(store, path)
    return store.read(M.STORE_SALES, STORE_SALES_SCHEMA)


@query("report_export", views=("sales", "store_sales"), sql="""
SELECT 'category' AS dataset, count(*) AS row_count FROM (SELECT category FROM sales
  WHERE category IS NOT NULL AND category <> '' GROUP BY category ORDER BY sum(net_sales) DESC LIMIT 30)
UNION ALL SELECT 'daily', count(DISTINCT sale_date) FROM store_sales
UNION ALL SELECT 'supplier', least(30, count(DISTINCT supplier)) FROM sales WHERE supplier <> ''
UNION ALL SELECT 'products', least(100, count(*)) FROM (
  SELECT DISTINCT product_code, product_name FROM sales WHERE product_name IS NOT NULL AND product_name <> '')
""")
def _s12(fx):
    """S11 + S12: the six datasets of the combined report written as CSV
    folders; rows of four of them counted in the files."""
    spark = fx.spark
    paths = X.combined_report(fx.sales, fx.store_sales, work_path(spark, "report"))
    out = None
    for name in ("category", "daily", "supplier", "products"):
        n = spark.read.option("header", True).csv(paths[name]).agg(F.count("*").alias("row_count")) \
            .select(F.lit(name).alias("dataset"), "row_count")
        out = n if out is None else out.unionByName(n)
    return out


@query("export_weekly", views=("store_sales",), sql="""
SELECT strftime(sale_date, '%Y') || '-W' ||
         lpad(cast(cast(strftime(sale_date, '%W') AS integer) + 1 AS varchar), 2, '0') AS week,
       min(sale_date) AS start_date, max(sale_date) AS end_date,
       cast(sum(net_sales) AS double) AS net_sales, sum(sold_qty) AS sold_qty,
       count(*) AS row_count, count(DISTINCT store) AS store_count
FROM store_sales WHERE sale_date IS NOT NULL AND file_id = 3 GROUP BY 1""")
def _s11(fx):
    """The 'weekly' dataset exported by name (file 3) as CSV, read back."""
    spark = fx.spark
    path = work_path(spark, "export")
    builders = X.export_builders(fx.sales, fx.store_sales, file_id=3)
    X.export_by_name(builders, "weekly", path)
    return spark.read.schema("week string, start_date date, end_date date, net_sales double, "
                             "sold_qty double, row_count long, store_count long") \
        .option("header", True).csv(path)


_SHEET_RAW_COLS = {"판매일자": "cast(sale_date AS string)", "매장코드": "store_code",
                   "매장명": "store", "분류명": "classification", "상품코드": "product_code",
                   "상품명": "product_name", "판매량": "cast(sold_qty AS string)",
                   "실판매금액": "cast(net_sales AS string)"}
# market segment -> sheet name, with the words of C7 in both languages
_SHEETS = {"AUTOMOBILE": "Clothing A", "BUILDING": "신발 2024", "FURNITURE": "ACCESSORIES", "MACHINERY": "의류시트"}
_SHEET_SQL = ("CASE data_type WHEN 'AUTOMOBILE' THEN '의류' WHEN 'BUILDING' THEN '신발' WHEN 'FURNITURE' THEN '잡화' "
              "WHEN 'MACHINERY' THEN '의류' ELSE data_type END")
_SCAT, _SSUP = Q.class_parts("classification")


@query("sheets_load", views=("store_sales",), sql=f"""
SELECT {Q.typed_select(STORE_SALES_SCHEMA, {
    "file_id": "5", "data_type": _SHEET_SQL, "sale_date": "sale_date", "store_code": "store_code",
    "store": "store", "classification": "classification", "category": _SCAT, "supplier": _SSUP,
    "product_code": "product_code", "product_name": "product_name", "sold_qty": "sold_qty",
    "net_sales": "net_sales"})}
FROM store_sales WHERE {Q.keep_store_line("store")}""")
def _s2(fx):
    """S2 + S8: a workbook stand-in with one CSV folder per sheet (sheet =
    market segment), read sheet by sheet with the sheet's data type (C7),
    aligned by header, cleaned and appended as store/day lines."""
    spark = fx.spark
    root = work_path(spark, "sheets")
    label = F.create_map(*[F.lit(x) for kv in _SHEETS.items() for x in kv])[F.col("data_type")]
    raw = fx.store_sales.select(F.coalesce(label, F.col("data_type")).alias("sheet"),
                                *[F.expr(v).alias(k) for k, v in _SHEET_RAW_COLS.items()])
    raw.write.partitionBy("sheet").option("header", True).options(**_PACKED).csv(root)
    # sheet names are workbook metadata: the written folders, read once
    names = [r.sheet for r in spark.read.option("header", True).csv(root).select("sheet").distinct().collect()]
    sheets = {n: f"{root}/sheet={n}" for n in names}
    store = TableStore(spark)
    G.save_store_sales(store, G.read_sheets(spark, sheets), 5)
    return store.read(M.STORE_SALES, STORE_SALES_SCHEMA)


@query("file_row_counts", views=("sales", "store_sales"), sql="""
SELECT file_id, count(*) AS row_count, 'sales' AS table_name FROM sales GROUP BY file_id
UNION ALL
SELECT file_id, count(*), 'store_sales' FROM store_sales GROUP BY file_id""")
def _t2(fx):
    """Inserted rows per file and table, derived from the fact tables."""
    return M.file_row_counts(fx.sales, fx.store_sales)


@query("catalog_load", views=("product_images",), sql=CLEAN_CATALOG_SQL)
def _s9(fx):
    """A raw catalog export replaces the catalog table; read back."""
    store = TableStore(fx.spark)
    G.load_catalog(store, raw_catalog_file(fx).limit(0), "old/")
    G.load_catalog(store, raw_catalog_file(fx), "img/")
    return store.read("product_images", PRODUCT_IMAGES_SCHEMA)


@query("inventory_load", views=("inventory",), sql=CLEAN_INVENTORY_SQL)
def _s10(fx):
    """A raw stock export replaces the stock table; read back."""
    store = TableStore(fx.spark)
    G.load_inventory(store, raw_stock_file(fx).limit(0))
    G.load_inventory(store, raw_stock_file(fx))
    return store.read("inventory", INVENTORY_SCHEMA)


def _all_files(fx):
    """A store with all lines of both fact tables, their four files recorded
    (T1) and counted; file 2 is of the store table's type."""
    store = TableStore(fx.spark)
    for name, kind in (("a.csv", "original"), ("b.xlsx", "monthly"), ("c.csv", "original"), ("d.csv", "original")):
        M.register_file(store, name, name, kind)
    store.append(M.SALES, G.conform(fx.sales, SALES_SCHEMA), ["file_id"])
    store.append(M.STORE_SALES, G.store_layout(G.conform(fx.store_sales, STORE_SALES_SCHEMA)), G.STORE_PARTS)
    M.refresh_row_counts(store)
    return store


_FILES_SQL = """(SELECT * FROM (VALUES (1, 'a.csv', 'original'), (2, 'b.xlsx', 'monthly'), (3, 'c.csv', 'original'),
  (4, 'd.csv', 'original')) f(id, filename, file_type))"""


@query("file_registry", views=("sales", "store_sales"), sql=f"""
SELECT cast(id AS integer) AS id, filename, file_type,
  (SELECT count(*) FROM sales WHERE file_id = id) + (SELECT count(*) FROM store_sales WHERE file_id = id) AS row_count,
  CASE WHEN id = 1 THEN '2024 Q1' END AS data_period FROM {_FILES_SQL} WHERE id <> 2""")
def _t13(fx):
    """Four files recorded and counted over both whole
    fact tables, one given a memo, one deleted; the active files."""
    store = _all_files(fx)
    M.set_file_period(store, 1, "2024 Q1")
    M.delete_file(store, 2)
    return M.active_files(store.read(M.FILES, FILES_SCHEMA)).select("id", "filename", "file_type", "row_count", "data_period")


@query("data_counts_registry", views=("sales", "store_sales"), sql="""
SELECT 'sales' AS table_name, count(*) AS row_count FROM sales WHERE file_id <> 2
UNION ALL SELECT 'store_sales', count(*) FROM store_sales WHERE file_id <> 2 UNION ALL SELECT 'files', 4""")
def _a14(fx):
    """Rows of the fact tables and of the registry after one of four
    files was deleted (the registry counts it still)."""
    store = _all_files(fx)
    M.delete_file(store, 2)
    return S.data_counts(sales=store.read(M.SALES, SALES_SCHEMA), store_sales=store.read(M.STORE_SALES, STORE_SALES_SCHEMA),
                         files=store.read(M.FILES, FILES_SCHEMA))


@query("custom_rows", views=("store_sales",), sql=f"""
SELECT {Q.typed_select(T.StructType([f for f in STORE_SALES_SCHEMA.fields if f.name != "file_id"]),
                       {c: c for c in _STORE_COLS if c != "file_id"})} FROM store_sales WHERE file_id = 2""")
def _s15(fx):
    """The raw rows of a file whose type ('monthly') leads to the store
    table, without internal columns and without the row cap, among the lines
    of all files."""
    return X.custom_rows(_all_files(fx), 2, limit=None)


@query("reset_tables", views=("sales",), sql=f"""
SELECT {_full(SALES_SCHEMA, _SALES_COLS)} FROM sales WHERE file_id = 3""")
def _t6(fx):
    """Whole tables emptied, then one file's lines appended; read back."""
    store = _all_files(fx)
    M.reset_all(store)
    store.append(M.SALES, G.conform(fx.sales.filter("file_id = 3"), SALES_SCHEMA), ["file_id"])
    return store.read(M.SALES, SALES_SCHEMA)


@query("snapshot_chain", views=("sales",), sql="""
SELECT link, file_id, count(*) AS row_count, cast(sum(net_sales) AS double) AS net_sales,
  CASE WHEN link = 1 OR (link = 3 AND file_id = 2) THEN link ELSE 1 END AS held_by
FROM sales, (VALUES (1), (2), (3)) l(link)
WHERE file_id <> 2 OR link = 1 OR (link = 3 AND sold_qty > 25) GROUP BY link, file_id""")
def _s13c(fx):
    """S13 + S14: three links of a chain (all lines; file 2 deleted; some of
    its lines loaded again), each restored into a store of its own."""
    spark, store = fx.spark, TableStore(fx.spark)
    root = work_path(spark, "chain")
    lines = G.conform(fx.sales, SALES_SCHEMA)
    store.replace(M.SALES, lines, ["file_id"])
    SN.take_snapshot(store, root)
    M.delete_file(store, 2)
    SN.take_snapshot(store, root)
    store.append(M.SALES, lines.filter("file_id = 2 and sold_qty > 25"), ["file_id"])
    SN.take_snapshot(store, root)
    out = None
    for link in (1, 2, 3):
        other = TableStore(spark)
        SN.restore_link(other, root, link)
        held = SN.manifest(spark, root, link).filter("table_name = 'sales'").select(
            F.col("part").cast("int").alias("file_id"), F.col("link").alias("held_by"))
        part = (other.read(M.SALES, SALES_SCHEMA).groupBy("file_id")
                .agg(F.count("*").alias("row_count"), F.sum("net_sales").cast("double").alias("net_sales"))
                .join(held, "file_id").withColumn("link", F.lit(link)))
        out = part if out is None else out.unionByName(part)
    return out


def _summarised(fx):
    """All files with their summaries; file 2 and year 1996 deleted."""
    store = _all_files(fx)
    SM.summarise_files(store, [1, 2, 3, 4])
    M.delete_file(store, 2)
    M.delete_year(store, 1996, None)
    return store


_LEFT = "FROM store_sales WHERE file_id <> 2 AND (sale_date IS NULL OR year(sale_date) <> 1996) AND"


@query("weekly_from_summary", views=("sales", "store_sales"),
       sql=REGISTRY["weekly_sales"].sql.replace("FROM store_sales WHERE", _LEFT))
def _a8s(fx):
    """A8 from day summaries and united bitmaps of stores, after a file and a
    year were deleted."""
    return SM.weekly_sales(_summarised(fx))


@query("kpis_from_summary", views=("sales", "store_sales"), sql=REGISTRY["summary_stats"].sql + " WHERE file_id <> 2")
def _a1s(fx):
    """A1 from file summaries and united bitmaps, after a file was deleted."""
    return SM.summary_stats(_summarised(fx))


def _search(fx, table, schema, columns):
    index = SearchIndex(fx.spark, schema, columns)
    index.save(fx.table(table).select(*[(F.col(f.name) if f.name in fx.table(table).columns else F.lit(None))
                                        .cast(f.dataType).alias(f.name) for f in schema.fields]))
    return index


@query("catalog_search_postings", views=("product_images",), sql=REGISTRY["catalog_search"].sql)
def _f5p(fx):
    """F5 by trigram postings."""
    return K.catalog_groups(_search(fx, "product_images", PRODUCT_IMAGES_SCHEMA, ["product_name"]).search("red")).limit(100)


@query("catalog_find_postings", views=("product_images",), sql="""
SELECT * FROM product_images WHERE contains(lower(product_name), 'bjk01') OR contains(lower(product_code), 'bjk01')""")
def _f11p(fx):
    """F11's search, of names and codes, by trigram postings: the rows found."""
    return _search(fx, "product_images", PRODUCT_IMAGES_SCHEMA, ["product_name", "product_code"]).search("BJK01")
