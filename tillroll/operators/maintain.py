"""File registry and table maintenance.

Row counts are derived from the fact tables or the upload ledger instead of
being mutated row by row. Deleting a file or a year hides its partitions
through the table's drop log (see ``sources.store``); no data is read or
rewritten but for the count of deleted lines. Nothing here collects table data
to the driver; the driver reads single-row aggregates only.

The registry is small and changed by reading it and writing it anew, so its
writers take turns (``sources.claims``); a new file's id is claimed before its
record is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FILES_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
from ..sources.ingest import STORE_PARTS, store_layout
from ..sources.store import TableStore

SALES, STORE_SALES, FILES = "sales", "store_sales", "files"
# tables of ``operators.summary``: deleted files and years leave them too
BY_FILE, BY_YEAR = ("day_sums", "day_stores", "key_sums", "key_sets"), ("day_sums", "day_stores")


def derive_files(sales: DataFrame, store_sales: DataFrame) -> DataFrame:
    """File registry derived from the fact tables: one row per ``file_id``
    with its total row count (T2 without mutation)."""
    s = sales.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    m = store_sales.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return (s.unionByName(m).groupBy("file_id")
            .agg(F.sum("n").alias("row_count"))
            .select(F.col("file_id").alias("id"), "row_count", F.lit("active").alias("status")))


def file_row_counts(sales: DataFrame, store_sales: DataFrame) -> DataFrame:
    """Inserted rows per file, per fact table."""
    s = sales.groupBy("file_id").agg(F.count(F.lit(1)).alias("row_count")) \
        .withColumn("table_name", F.lit(SALES))
    m = store_sales.groupBy("file_id").agg(F.count(F.lit(1)).alias("row_count")) \
        .withColumn("table_name", F.lit(STORE_SALES))
    return s.unionByName(m)


def active_files(files: DataFrame) -> DataFrame:
    """Active files, newest first."""
    return files.filter(F.col("status") == "active").orderBy(F.col("upload_date").desc(),
                                                             F.col("id").desc())


def registry_turn(store: TableStore):
    """Context: this writer alone changes the registry."""
    return store.claims.turn(FILES)


def _file_row(store: TableStore, file_id: int, filename: str, original_name: str, file_type: str, row_count: int) -> DataFrame:
    row = store.spark.createDataFrame(
        [(file_id, filename, original_name, file_type, row_count, None, "active", None)],
        FILES_SCHEMA).withColumn("upload_date", F.current_timestamp())
    return row.select(*FILES_SCHEMA.fieldNames())


def register_file(store: TableStore, filename: str, original_name: str, file_type: str,
                  row_count: int = 0) -> int:
    """Record a loaded file; returns its new id, which no other file gets
    even if both are recorded at once."""
    with registry_turn(store):
        top = store.read(FILES, FILES_SCHEMA).agg(F.max("id").alias("m")).first()["m"]
        new_id = store.claims.take(f"{FILES}-ids", (top or 0) + 1)
        store.append(FILES, _file_row(store, new_id, filename, original_name, file_type, row_count))
    return new_id


def _change_files(store: TableStore, change) -> None:
    """Writes the registry anew, as ``change`` makes it of what it is."""
    with registry_turn(store):
        store.replace(FILES, change(store.read(FILES, FILES_SCHEMA)).select(*FILES_SCHEMA.fieldNames()))


def set_row_count(store: TableStore, file_id: int, row_count: int, increment: bool = False) -> None:
    """Set (or add to) one file's row_count; only the small registry is
    rewritten."""
    new = (F.coalesce(F.col("row_count"), F.lit(0)) + F.lit(row_count)) if increment else F.lit(row_count)
    _change_files(store, lambda files: files.withColumn(
        "row_count", F.when(F.col("id") == file_id, new.cast("long")).otherwise(F.col("row_count"))))


def refresh_row_counts(store: TableStore) -> None:
    """T2 for all files at once: recount every file from the fact tables (a
    full scan of both; for one new file use ``set_row_count``)."""
    counts = derive_files(store.read(SALES, SALES_SCHEMA),
                          store.read(STORE_SALES, STORE_SALES_SCHEMA)).select("id", F.col("row_count").alias("_n"))
    _change_files(store, lambda files: files.join(counts, "id", "left")
                  .withColumn("row_count", F.coalesce("_n", F.lit(0)).cast("long")))


def set_file_period(store: TableStore, file_id: int, data_period: str) -> None:
    """Set a file's free-text period memo."""
    _change_files(store, lambda files: files.withColumn(
        "data_period", F.when(F.col("id") == file_id, F.lit(data_period)).otherwise(F.col("data_period"))))


def set_status(store: TableStore, file_ids: list[int], status: str) -> None:
    """Marks files in the registry."""
    _change_files(store, lambda files: files.withColumn(
        "status", F.when(F.col("id").isin(file_ids), F.lit(status)).otherwise(F.col("status"))))


def delete_file(store: TableStore, file_id: int) -> None:
    """T4: drop one file's rows from both fact tables; mark the file deleted.

    The file's partitions go to the tables' drop logs, so the delete
    reads and rewrites no data; only the small file registry is rewritten.
    """
    for table in (SALES, STORE_SALES, *BY_FILE):
        store.drop_partitions(table, "file_id", [file_id])
    set_status(store, [file_id], "deleted")


def open_uploads(store: TableStore, docs: DataFrame) -> DataFrame:
    """T1 for chunked uploads: ``docs`` (file_id, original_name, file_type)
    -> (name, id). Files not yet in the registry are recorded, under ids that
    nobody else gets.

    Documents that carry no id belong to the newest active file of their
    original name, or open a new one; so a repeated call gives the same ids.
    """
    docs = docs.withColumn("name", F.coalesce("original_name", F.lit("")))
    names = docs.filter("file_id is null").groupBy("name").agg(F.min("file_type").alias("file_type"))

    def newest(files: DataFrame) -> DataFrame:
        return (files.filter(F.col("status") == "active").groupBy(F.col("filename").alias("name"))
                .agg(F.max("id").alias("id")))

    with registry_turn(store):
        files = store.read(FILES, FILES_SCHEMA)
        fresh = names.join(newest(files), "name", "left_anti")
        n = fresh.count()
        first = 0
        if n:
            top = files.select("id").union(docs.select("file_id")).agg(F.max("id")).first()[0] or 0
            first = store.claims.take(f"{FILES}-ids", top + 1, n)
        # new names of one batch of documents: a bounded window
        opened = fresh.withColumn("id", (F.lit(first - 1) + F.row_number().over(Window.orderBy("name"))).cast("int"))
        given = (docs.filter("file_id is not null").groupBy(F.col("file_id").alias("id"))
                 .agg(F.min("name").alias("name"), F.min("file_type").alias("file_type"))
                 .join(files.select("id"), "id", "left_anti"))
        new = opened.select("id", "name", "file_type").unionByName(given.select("id", "name", "file_type"))
        rows = new.select("id", F.col("name").alias("filename"), F.col("name").alias("original_name"), "file_type",
                          F.lit(0).cast("long").alias("row_count"), F.current_timestamp().alias("upload_date"),
                          F.lit("active").alias("status"), F.lit(None).cast("string").alias("data_period"))
        if n or not given.isEmpty():
            store.append(FILES, rows.select(*FILES_SCHEMA.fieldNames()))
            files = store.read(FILES, FILES_SCHEMA)
    return names.select("name").join(newest(files), "name")


def set_row_counts(store: TableStore, counts: DataFrame) -> None:
    """row_count of the files in ``counts`` (id, row_count)."""
    new = counts.select("id", F.col("row_count").alias("_n"))
    _change_files(store, lambda files: files.join(new, "id", "left")
                  .withColumn("row_count", F.coalesce("_n", "row_count").cast("long")))


def delete_year(store: TableStore, year: int, valid_years: tuple[int, int] | None = (2000, 2100)
                ) -> DataFrame:
    """T5: drop store lines of one calendar year.

    The year's partitions are hidden by one entry of the drop log; lines
    without a date stay, and lines of that year loaded later show. The only
    data read are the year's partitions, for the count. ``valid_years`` is
    the accepted input range (the web form's check); ``None`` accepts any
    year. Returns ``(table_name, deleted)`` rows; the sales table has no dates
    and is left alone (0).
    """
    if valid_years and not valid_years[0] <= int(year) <= valid_years[1]:
        raise ValueError(f"year must be between {valid_years[0]} and {valid_years[1]}")
    n = 0
    if store.current_version(STORE_SALES) is not None:
        n = store.read(STORE_SALES, STORE_SALES_SCHEMA, F.col("sale_year") == int(year)).count()
        for table in (STORE_SALES, *BY_YEAR):
            store.drop_partitions(table, "sale_year", [int(year)])
    return store.spark.createDataFrame([(STORE_SALES, n), (SALES, 0)],
                                       "table_name string, deleted long")


def reset_all(store: TableStore) -> None:
    """Empty both fact tables and the file registry. File and row ids
    start again."""
    spark = store.spark
    with registry_turn(store):
        store.replace(SALES, spark.createDataFrame([], SALES_SCHEMA), ["file_id"])
        store.replace(STORE_SALES, store_layout(spark.createDataFrame([], STORE_SALES_SCHEMA)), STORE_PARTS)
        store.replace(FILES, spark.createDataFrame([], FILES_SCHEMA))
        for name in (f"{FILES}-ids", f"{SALES}-rows", f"{STORE_SALES}-rows"):
            store.claims.forget(name)
