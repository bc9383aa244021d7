"""Sinks and raw-row access: dataset export (S11), combined report (S12),
snapshot and restore (S13, S14) and the raw rows of one file (S15)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILES_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
from ..session import small_splits, work_path
from .ingest import STORE_PARTS, store_layout
from .row_ids import id_range, restored, stored_schema
from .store import path_exists

INTERNAL_COLUMNS = ("id", "file_id", "created_at")


def file_rows(df: DataFrame, file_id=None, limit: int | None = None) -> DataFrame:
    """Rows of one file without internal columns; optional row cap
    (the web page used 100 000)."""
    if file_id is not None:
        df = df.filter(F.col("file_id") == F.lit(file_id))
    df = df.drop(*[c for c in INTERNAL_COLUMNS if c in df.columns])
    return df.limit(limit) if limit else df


def custom_rows(store, file_id: int, limit: int | None = None) -> DataFrame:
    """Raw rows of one active file; the registry's file type says which
    fact table they are in ('monthly': store lines, else sales lines). The web
    page asks for at most 100 000 rows; a caller that wants so passes
    ``limit``."""
    files = store.read("files", FILES_SCHEMA)
    row = files.filter((F.col("id") == int(file_id)) & (F.col("status") == "active")).select("file_type").first()
    if row is None:
        raise KeyError(f"no active file {file_id}")
    table = "store_sales" if row[0] == "monthly" else "sales"
    return file_rows(store.read(table, SNAPSHOT_TABLES[table]), file_id, limit)


BOM = "\ufeff"


def export_dataset(df: DataFrame, path: str, fmt: str = "csv", bom: bool = True) -> str:
    """Write one dataset as CSV with a header (or Parquet / JSON).

    Output is a folder of part files written by the executors; nothing
    passes through the driver. CSV is what spreadsheets open: quotes are
    doubled, and every file begins with a byte order mark unless ``bom`` is
    off. (It stands before the first header, as a file begins with that.)
    """
    if fmt == "csv" and bom and df.columns:
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    w = df.write.mode("overwrite")
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def save_report(datasets: dict[str, DataFrame], path: str, fmt: str = "csv") -> dict[str, str]:
    """Several datasets under one report folder, one sub-folder each."""
    return {name: export_dataset(df, f"{path.rstrip('/')}/{name}", fmt)
            for name, df in datasets.items()}


REPORT = ("supplier", "category", "products", "daily", "store", "matrix")


# what the datasets of the report read of either fact table
REPORT_SALES = ("supplier", "category", "classification", "product_code", "product_name", "net_sales", "sold_qty")
REPORT_STORE = ("sale_date", "store", "net_sales", "sold_qty")


def _held(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """These columns, written once to the work folder, so that ``df`` is not
    made again for every dataset."""
    spark, path = df.sparkSession, work_path(df.sparkSession, "report", name)
    df = df.select(*columns)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def combined_report(sales: DataFrame, store_sales: DataFrame, path: str, fmt: str = "csv") -> dict[str, str]:
    """The six datasets of the combined report, unfiltered, one folder
    each under ``path``, all from one reading of either fact table."""
    builders = export_builders(_held(sales, REPORT_SALES, "sales"), _held(store_sales, REPORT_STORE, "store_sales"))
    return save_report({name: builders[name]() for name in REPORT}, path, fmt)


def export_by_name(builders: dict[str, Callable[[], DataFrame]], name: str, path: str,
                   fmt: str = "csv") -> str:
    """S11 dispatch: dataset name -> operator -> write."""
    if name not in builders:
        raise KeyError(f"unknown dataset {name}; known: {sorted(builders)}")
    return export_dataset(builders[name](), path, fmt)


# --- S13 / S14 ---------------------------------------------------------------------
SNAPSHOT_TABLES = {"sales": SALES_SCHEMA, "store_sales": STORE_SALES_SCHEMA, "files": FILES_SCHEMA}


MANIFEST = "table_name string, row_count long"
ROWS_PER_FILE = 500_000  # of a snapshot: its files are compressed, so each is read by one task


def snapshot(path: str, sales: DataFrame, store_sales: DataFrame, files: DataFrame | None = None
             ) -> str:
    """All sales, all store lines and the active files as JSON folders.
    A manifest with the row counts is written last: a snapshot without one is
    not complete."""
    base = path.rstrip("/")
    spark = sales.sparkSession
    files = spark.createDataFrame([], FILES_SCHEMA) if files is None else files.filter(F.col("status") == "active")
    counts = []
    for table, df in (("sales", sales), ("store_sales", store_sales), ("files", files)):
        seen = Observation(f"snapshot_{table}")
        with small_splits(spark):
            (df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "gzip")
             .option("maxRecordsPerFile", ROWS_PER_FILE).json(f"{base}/{table}"))
        counts.append((table, int(seen.get.get("n", 0))))
    spark.createDataFrame(counts, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return base


def read_snapshot(spark: SparkSession, path: str, table: str, schema=None) -> DataFrame:
    """Read one table of a snapshot back with its declared schema, so
    types (dates, decimals) survive the JSON round trip. ``stored_schema``
    reads the row ids and load times of a fact table too."""
    schema = schema or SNAPSHOT_TABLES[table]
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/{table}")


def export_builders(sales: DataFrame, store_sales: DataFrame, **filters
                    ) -> dict[str, Callable[[], DataFrame]]:
    """The eight exportable datasets by name, each a library operator.

    ``filters`` (file_id, start_date, end_date) go to the operators that take
    them; supplier / category / products / matrix take only ``file_id``.
    """
    from ..operators import drilldown as D, sales as S

    fid = filters.get("file_id")
    rng = {k: filters.get(k) for k in ("file_id", "start_date", "end_date")}
    return {
        "supplier": lambda: S.sales_by_supplier(sales, fid),
        "category": lambda: S.sales_by_category(sales, fid),
        "products": lambda: S.top_products(sales, fid),
        "daily": lambda: S.daily_sales(store_sales, **rng),
        "weekly": lambda: S.weekly_sales(store_sales, **rng),
        "store": lambda: S.store_sales_top(store_sales, **rng),
        "matrix": lambda: D.matrix_export(sales, fid),
        "monthly": lambda: S.monthly_sales(store_sales, **rng),
    }


def restore_snapshot(store, path: str) -> dict[str, int]:
    """Replace the fact tables and the file registry with a snapshot.

    Nothing changes unless the snapshot has a manifest and every table holds
    as many rows as that says. Each table is then written as a new version;
    lines keep the row ids and load times that the snapshot has. Returns the
    restored row counts.
    """
    spark, base = store.spark, path.rstrip("/")
    if not path_exists(spark, f"{base}/manifest"):
        raise FileNotFoundError(f"no complete snapshot at {path}")
    want = {r["table_name"]: r["row_count"] for r in spark.read.schema(MANIFEST).json(f"{base}/manifest").collect()}
    if set(want) != set(SNAPSHOT_TABLES):
        raise ValueError(f"the snapshot at {path} lacks {sorted(set(SNAPSHOT_TABLES) - set(want))}")
    found = {t: read_snapshot(spark, path, t, s if t == "files" else stored_schema(s)) for t, s in SNAPSHOT_TABLES.items()}
    held = {t: id_range(df) for t, df in found.items()}  # rows and ids in one reading
    for table in found:
        if held[table]["n"] != want[table]:
            raise ValueError(f"{table} in the snapshot at {path} does not hold {want[table]} rows")
    with store.claims.turn("files"):
        store.replace("sales", restored(store, "sales", found["sales"], held["sales"]), ["file_id"])
        store.replace("store_sales", store_layout(restored(store, "store_sales", found["store_sales"], held["store_sales"])), STORE_PARTS)
        store.replace("files", found["files"])
    return want
