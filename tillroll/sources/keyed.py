"""Tables that are read by key.

A keyed copy of a table is bucketed and sorted by one column, with a Parquet
bloom filter on it. A lookup of one key reads one bucket, and in it only the
row groups that may hold the key; two copies with the same key and number of
buckets are joined, and grouped by that key, without a shuffle.

Spark keeps the buckets' description in its catalog, so a copy is registered
there under a name of its own, in each session that opens it. Files and their
layout are Spark's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INVENTORY_SCHEMA, PRODUCT_IMAGES_SCHEMA
from ..session import work_path

#: copy -> (columns, key)
COPIES: dict[str, tuple[T.StructType, str]] = {
    "catalog_by_option": (PRODUCT_IMAGES_SCHEMA, "supplier_option"),
    "catalog_by_code": (PRODUCT_IMAGES_SCHEMA, "product_code"),
    "inventory_by_option": (INVENTORY_SCHEMA, "supplier_option"),
}


class KeyedTables:
    """Keyed copies under one folder. ``buckets`` is fixed for the folder: a
    bucket should be a few hundred MB at most."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.root = (root or work_path(spark, "keyed")).rstrip("/")
        self._names: dict[str, str] = {}

    def save(self, copy: str, df: DataFrame) -> DataFrame:
        """Writes a copy anew and opens it."""
        schema, key = COPIES[copy]
        table = f"keyed_{uuid.uuid4().hex}"
        rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in schema.fields])
        # partitioned as the buckets are: one file each
        (rows.repartition(self.buckets, key).write.format("parquet").mode("overwrite")
         .option("path", f"{self.root}/{copy}").option(f"parquet.bloom.filter.enabled#{key}", "true")
         .bucketBy(self.buckets, key).sortBy(key).saveAsTable(table))
        self._names[copy] = table
        return self.spark.table(table)

    def open(self, copy: str) -> DataFrame:
        """A copy that is there, of this or another session."""
        if copy not in self._names:
            schema, key = COPIES[copy]
            table = f"keyed_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/{copy}'")
            self._names[copy] = table
        return self.spark.table(self._names[copy])


def save_catalog(tables: KeyedTables, images: DataFrame) -> None:
    """Both copies of the catalog."""
    for copy in ("catalog_by_option", "catalog_by_code"):
        tables.save(copy, images)


def options_of_product(tables: KeyedTables, product_code: str, most: int = 500) -> DataFrame:
    """J1 from the copies: one product's options with every matching stock
    row. The catalog lookup reads one bucket, the stock lookups those of the
    product's options; a product of more than ``most`` options is joined
    bucket by bucket."""
    from ..operators.catalog import product_options_with_stock

    mine = tables.open("catalog_by_code").filter(F.col("product_code") == str(product_code))
    options = [r[0] for r in mine.select("supplier_option").distinct().limit(most + 1).collect()]
    stock = tables.open("inventory_by_option")
    if len(options) <= most:
        stock = stock.filter(F.col("supplier_option").isin([o for o in options if o is not None]))
    return product_options_with_stock(mine, stock, product_code=product_code)
