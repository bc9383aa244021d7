"""Versioned Parquet tables on shared storage.

Plain Parquet has no row delete and no commit, so a table is a folder of
versions with two small logs beside it:

* ``_versions`` names the current version. Replacing a table writes a new
  version folder and then logs its number.
* ``_drops`` holds deletions: (version, column, value, generation). Every
  write carries a generation, a hidden partition column; a drop hides the
  partitions with that value whose generation is *smaller* than its own.
  A delete therefore reads and rewrites no data, and rows written to the same
  value afterwards (under the drop's generation or a later one) are visible.
* replacing some partitions writes the new rows under the next generation
  (dynamic overwrite, so a retry replaces its own rows) and then logs the drop
  of the older ones. A driver that is lost in between leaves the old rows in
  place until the retry.

The logs are read anew at each operation. A write that finds the version
moved when it is done fails, so that no row lands in a version that nobody
reads. All I/O is Spark's own, on any filesystem Spark can write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_splits, work_path
from .claims import Claims

GENERATION = "_generation"
PRUNED_DROPS = 500  # drops that become a partition filter; more are joined

_LOG_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()),
                            T.StructField("written_at", T.TimestampType())])
_DROP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()),
                             T.StructField("column", T.StringType()),
                             T.StructField("value", T.LongType()),
                             T.StructField("generation", T.IntegerType()),
                             T.StructField("written_at", T.TimestampType())])


class VersionConflict(RuntimeError):
    """The table got a new version while this write was under way."""


def path_exists(spark: SparkSession, path: str) -> bool:
    """False only where the path is not there; any other trouble is raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or work_path(spark, "store")).rstrip("/")

    # -- layout and logs -------------------------------------------------------
    def path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v{version:06d}"

    def _log(self, table: str, name: str, schema: T.StructType) -> DataFrame | None:
        path = f"{self.root}/{table}/{name}"
        return self.spark.read.schema(schema).parquet(path) if path_exists(self.spark, path) else None

    def current_version(self, table: str) -> int | None:
        log = self._log(table, "_versions", _LOG_SCHEMA)
        return None if log is None else log.agg(F.max("version")).first()[0]

    def _commit(self, table: str, version: int) -> None:
        (self.spark.range(1).select(F.lit(version).cast("int").alias("version"),
                                    F.current_timestamp().alias("written_at"))
         .coalesce(1).write.mode("append").parquet(f"{self.root}/{table}/_versions"))

    def _drops(self, table: str, version: int) -> DataFrame | None:
        """(column, value, generation): the latest drop of each value."""
        log = self._log(table, "_drops", _DROP_SCHEMA)
        return None if log is None else (log.filter(F.col("version") == version).groupBy("column", "value")
                                         .agg(F.max("generation").alias("generation")))

    def _generation(self, table: str, version: int) -> int:
        drops = self._drops(table, version)
        return 0 if drops is None else drops.agg(F.max("generation")).first()[0] or 0

    def _unmoved(self, table: str, version: int | None) -> None:
        # a first write may share version 1 with another one
        if self.current_version(table) not in ((None, 1) if version is None else (version,)):
            raise VersionConflict(f"{table} was replaced during a write; repeat it")

    @property
    def claims(self) -> Claims:
        return Claims(self.spark, f"{self.root}/_claims")

    # -- reads -----------------------------------------------------------------
    def read(self, table: str, schema: T.StructType, where=None) -> DataFrame:
        """The visible rows of the current version, in ``schema``. ``where``
        may also name partition columns that the schema leaves out."""
        v = self.current_version(table)
        if v is None:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField(GENERATION, T.IntegerType())])
        drops = self._drops(table, v)
        named = {r["column"]: r["n"] for r in
                 ([] if drops is None else drops.groupBy("column").agg(F.count("*").alias("n")).collect())}
        extra = [T.StructField(c, T.IntegerType()) for c in named if c not in schema.fieldNames()]
        df = self.spark.read.schema(T.StructType([*full.fields, *extra])).parquet(self.path(table, v))
        for column, n in named.items():
            mine = drops.filter(F.col("column") == column)
            if n <= PRUNED_DROPS:  # a partition filter: nothing dropped is read
                for r in mine.collect():
                    df = df.filter(F.col(column).isNull() | (F.col(column) != r["value"])
                                   | (F.col(GENERATION) >= r["generation"]))
            else:
                gone = mine.select(F.col("value").alias("_value"), F.col("generation").alias("_until"))
                df = df.join(gone, (F.col(column) == F.col("_value")) & (F.col(GENERATION) < F.col("_until")), "left_anti")
        if where is not None:
            df = df.filter(where)
        return df.select(*[F.col(f"`{c}`") for c in schema.fieldNames()])

    # -- writes ----------------------------------------------------------------
    def _write(self, df: DataFrame, table: str, version: int, generation: int,
               partition_by: list[str] | None, mode: str) -> None:
        w = df.withColumn(GENERATION, F.lit(generation)).write.mode(mode).option("compression", "zstd")
        if mode == "overwrite":
            w = w.option("partitionOverwriteMode", "dynamic")
        with small_splits(df.sparkSession):
            w.partitionBy(*(partition_by or []), GENERATION).parquet(self.path(table, version))

    def append(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Add rows to the current version (creating version 1 if needed)."""
        v = self.current_version(table)
        self._write(df, table, v or 1, self._generation(table, v) if v else 0, partition_by, "append")
        self._unmoved(table, v)
        if v is None:
            self._commit(table, 1)

    def replace(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write ``df`` as a new version and switch to it."""
        old = self.current_version(table)
        # a folder of its own: not that of a write that was lost or is under way
        v = (old or 0) + 1
        while path_exists(self.spark, self.path(table, v)) or not self.claims.create_once(
                f"{self.claims.root}/{table}-versions/{v:06d}"):
            v += 1
        self._write(df, table, v, 0, partition_by, "append")
        self._unmoved(table, old)
        self._commit(table, v)
        return v

    def _log_drops(self, table: str, version: int, column: str, values: DataFrame, generation: int) -> None:
        (values.select(F.lit(version).alias("version"), F.lit(column).alias("column"),
                       F.col("value").cast("long").alias("value"), F.lit(generation).alias("generation"),
                       F.current_timestamp().alias("written_at")).filter("value is not null").distinct()
         .coalesce(1).write.mode("append").parquet(f"{self.root}/{table}/_drops"))

    def drop_partitions(self, table: str, column: str, values: list[int]) -> None:
        """Hide the partitions with these values; later writes to them show."""
        v = self.current_version(table)
        if v is None or not values:
            return
        frame = self.spark.createDataFrame([(int(x),) for x in values], "value long")
        self._log_drops(table, v, column, frame, self._generation(table, v) + 1)
        self._unmoved(table, v)

    def replace_partitions(self, table: str, df: DataFrame, column: str, values: DataFrame,
                           partition_by: list[str]) -> None:
        """Put ``df`` in the place of the partitions whose ``column`` is among
        ``values`` (one column, ``value``); a value without rows in ``df`` is
        left empty."""
        v = self.current_version(table)
        if v is None:
            self._write(df, table, 1, 0, partition_by, "overwrite")
            self._unmoved(table, None)
            self._commit(table, 1)
            return
        generation = self._generation(table, v) + 1
        self._write(df, table, v, generation, partition_by, "overwrite")
        self._log_drops(table, v, column, values, generation)
        self._unmoved(table, v)

    def vacuum(self, table: str, keep: int = 1) -> list[str]:
        """Delete the folders of versions older than the last ``keep``; the
        current one always stays. Readers of older versions must be done.
        Returns the deleted paths."""
        v = self.current_version(table)
        gone = []
        jvm = self.spark._jvm
        for k in range(1, (v or 0) - max(keep, 1) + 1):
            path = jvm.org.apache.hadoop.fs.Path(self.path(table, k))
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(path) and fs.delete(path, True):
                gone.append(self.path(table, k))
        return gone


def scan(df: DataFrame, columns: list[str] | None = None, where=None, order_by=None,
         limit: int | None = None) -> DataFrame:
    """Table scan with optional projection, filter, order and limit.

    ``where`` is a Column or a SQL predicate string; ``order_by`` a list of
    column names (prefix ``-`` for descending) or Columns. Filters and the
    projection reach the Parquet scan; order + limit plans as a top-k.
    """
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    if order_by:
        cols = []
        for c in order_by:
            if isinstance(c, str) and c.startswith("-"):
                cols.append(F.col(c[1:]).desc_nulls_last())
            elif isinstance(c, str):
                cols.append(F.col(c).asc_nulls_first())
            else:
                cols.append(c)
        df = df.orderBy(*cols)
    return df.limit(limit) if limit else df
