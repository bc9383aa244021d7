"""Row ids and load times of stored lines.

Ids are dense: a load of n lines gets the n numbers behind the last ones. Two
passes give them without a shuffle of the lines or a counter that tasks share:

1. the cleaned lines are written as they are; the counts of the files are read
   from the Parquet footers, summed up file by file, and the load's range of
   numbers is claimed;
2. a line's id is its file's offset plus its place in the file, which a
   repeated task finds again.

A load that fails after its claim leaves its numbers unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_splits, work_path

ROW_ID, CREATED = "id", "created_at"
FILE = "_metadata.file_path"


def stored_schema(schema: T.StructType) -> T.StructType:
    """A fact table's columns as stored: with row id and load time."""
    return T.StructType([T.StructField(ROW_ID, T.LongType()), *schema.fields, T.StructField(CREATED, T.TimestampType())])


def with_row_ids(store, table: str, df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with ``id`` and ``created_at``, and its number of rows. The rows
    are written once to the work folder, so ``df`` is evaluated once."""
    spark = df.sparkSession
    path = work_path(spark, "row-ids")
    with small_splits(spark):
        df.write.option("compression", "zstd").parquet(path)
    lines = spark.read.schema(df.schema).parquet(path)
    # one small row per file; the file names give a fixed order
    files = lines.groupBy(F.col(FILE).alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    return numbered(store, table, lines, df.columns, files)


def numbered(store, table: str, lines: DataFrame, columns: list[str], files: DataFrame) -> tuple[DataFrame, int]:
    """``columns`` of ``lines``, which are read from Parquet files, with ``id``
    and ``created_at``, and their number. ``files`` (_file, _n) are the files
    that count, each with the number of its rows."""
    files = files.withColumn("_upto", F.sum("_n").over(Window.orderBy("_file")))
    total = files.agg(F.max("_upto")).first()[0] or 0
    first = store.claims.take(f"{table}-rows", 1, total) if total else 1
    offsets = files.select("_file", (F.col("_upto") - F.col("_n") + first).alias("_first"))
    placed = lines.select(*columns, F.col(FILE).alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # one small row per file, so that the lines stay where they are
    out = (placed.join(F.broadcast(offsets), "_file")
           .select((F.col("_first") + F.col("_at")).alias(ROW_ID), *columns, F.current_timestamp().alias(CREATED)))
    return out, total


def id_range(df: DataFrame) -> Row:
    """(n, have, top): lines, those with an id, and the largest id."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(ROW_ID).alias("have"), F.max(ROW_ID).alias("top")).first()


def restored(store, table: str, df: DataFrame, held: Row | None = None) -> DataFrame:
    """Lines of a snapshot with the ids they had; later loads go on behind the
    largest. Lines without ids, of an older snapshot, get new ones. ``held``
    is their ``id_range`` if it is known."""
    held = held or id_range(df)
    keep = store.claims
    keep.forget(f"{table}-rows")
    if held["have"] < held["n"]:
        return with_row_ids(store, table, df.drop(ROW_ID, CREATED))[0]
    if held["top"]:
        keep.take(f"{table}-rows", 1, held["top"])
    return df
