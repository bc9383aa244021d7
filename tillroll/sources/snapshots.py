"""Chains of incremental snapshots.

A snapshot is a link of a chain. Tables are seen by partition (file, and year
for store lines); each partition has a digest that does not depend on the order
of its rows. A new link writes only the partitions whose digest the link before
does not have; its manifest names, for every partition, the link that holds it.
So a link is complete with the files of the links it names, and any link can be
restored.

A manifest is written last: a link without one is not complete and is passed
over. Partitions are found, compared and written by Spark; the driver reads
manifest rows, one per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FILES_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
from ..session import small_splits
from .claims import Claims
from .ingest import STORE_PARTS, store_layout
from .row_ids import restored, stored_schema
from .store import TableStore, path_exists

PART = "_part"
MANIFEST = "table_name string, part string, row_count long, digest string, link int"


def _tables() -> dict:
    """table -> (columns, partition): columns need a session, so they are
    made when asked for."""
    def file(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("none"))

    return {"sales": (stored_schema(SALES_SCHEMA), file("file_id")),
            "store_sales": (stored_schema(STORE_SALES_SCHEMA), F.concat_ws("-", file("file_id"), F.year("sale_date").cast("string"))),
            "files": (FILES_SCHEMA, F.lit("all"))}


def digests(df: DataFrame, part: Column) -> DataFrame:
    """(part, row_count, digest): sums of two hashes of each row, in halves
    that do not overflow, so equal rows count as often as they occur."""
    sums = []
    for seed in (0, 1):
        h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])
        sums += [F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(h, 33))]
    return df.groupBy(part.alias("part")).agg(
        F.count("*").alias("row_count"), F.concat_ws("-", *[F.hex(s) for s in sums]).alias("digest"))


def _links(spark: SparkSession, root: str) -> list[int]:
    """Complete links, in order."""
    names = Claims(spark, root).names(root)
    return [int(n) for n in names if n.isdigit() and path_exists(spark, f"{root}/{n}/manifest/_SUCCESS")]


def manifest(spark: SparkSession, root: str, link: int) -> DataFrame:
    """(table_name, part, row_count, digest, link): which link holds what."""
    return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/{link:06d}/manifest")


def take_snapshot(store: TableStore, root: str) -> int:
    """Adds a link with the store's tables as they are; returns its number."""
    spark, root = store.spark, root.rstrip("/")
    before = _links(spark, root)
    claims = Claims(spark, root)
    link = claims.take("_links", (before[-1] if before else 0) + 1)
    known = None
    if before:
        known = manifest(spark, root, before[-1]).select(
            "table_name", "part", "digest", F.col("row_count").alias("_rows"), F.col("link").alias("_link"))
    rows_of = None
    for table, (schema, part) in _tables().items():
        rows = store.read(table, schema)
        now = digests(rows, part).withColumn("table_name", F.lit(table))
        if known is not None:
            now = now.join(known, ["table_name", "part", "digest"], "left")
            same = F.col("_rows") == F.col("row_count")
            now = now.withColumn("link", F.when(same, F.col("_link")).otherwise(F.lit(link)))
        else:
            now = now.withColumn("link", F.lit(link))
        # one small row per partition
        now = spark.createDataFrame(now.select("table_name", "part", "row_count", "digest", "link").collect(), MANIFEST)
        changed = now.filter(F.col("link") == link).select(F.col("part").alias(PART))
        # the store's files hold one partition each, so the rows are not dealt by partition
        with small_splits(spark):
            (rows.withColumn(PART, part).join(F.broadcast(changed), PART, "left_semi").write.partitionBy(PART)
             .option("compression", "zstd").mode("overwrite").parquet(f"{root}/{link:06d}/{table}"))
        rows_of = now if rows_of is None else rows_of.unionByName(now)
    rows_of.coalesce(1).write.mode("overwrite").parquet(f"{root}/{link:06d}/manifest")
    return link


def read_link(spark: SparkSession, root: str, link: int, table: str) -> DataFrame:
    """One table as it was when the link was taken. A partition comes from
    the link that its manifest names; others are not read."""
    root = root.rstrip("/")
    schema, _ = _tables()[table]
    parts = manifest(spark, root, link).filter(F.col("table_name") == table)
    out = spark.createDataFrame([], schema)
    for r in parts.groupBy("link").agg(F.collect_list("part").alias("parts")).collect():
        held = spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.StringType())])).parquet(
            f"{root}/{r['link']:06d}/{table}")
        out = out.unionByName(held.filter(F.col(PART).isin(r["parts"])).drop(PART))
    return out


def _unnamed(spark: SparkSession, root: str, link: int, table: str) -> bool:
    """Whether the link's own files hold a partition that its manifest does
    not say they hold."""
    held = spark.read.schema(f"{PART} string").parquet(f"{root}/{link:06d}/{table}").select(F.col(PART).alias("part")).distinct()
    mine = manifest(spark, root, link).filter((F.col("table_name") == table) & (F.col("link") == link))
    return not held.join(mine, "part", "left_anti").isEmpty()


def restore_link(store: TableStore, root: str, link: int | None = None) -> dict[str, int]:
    """Puts the tables of a link (default: the last) in the store's place.
    Nothing changes unless every partition has the digest that the manifest
    says, and there are no others. Returns the row counts."""
    spark, root = store.spark, root.rstrip("/")
    links = _links(spark, root)
    link = links[-1] if link is None and links else link
    if link not in links:
        raise FileNotFoundError(f"no complete link {link} at {root}")
    found, counts = {}, {}
    for table, (_, part) in _tables().items():
        found[table] = read_link(spark, root, link, table)
        want = manifest(spark, root, link).filter(F.col("table_name") == table).select("part", "row_count", "digest")
        have = digests(found[table], part).select("part", F.col("row_count").alias("n"), F.col("digest").alias("d"))
        same = F.col("row_count").eqNullSafe(F.col("n")) & F.col("digest").eqNullSafe(F.col("d"))
        odd = want.join(have, "part", "full").agg(F.count_if(~same).alias("odd"), F.sum("row_count").alias("rows")).first()
        if odd["odd"] or _unnamed(spark, root, link, table):
            raise ValueError(f"{table} of link {link} at {root} is not what its manifest says")
        counts[table] = odd["rows"] or 0
    with store.claims.turn("files"):
        store.replace("sales", restored(store, "sales", found["sales"]), ["file_id"])
        store.replace("store_sales", store_layout(restored(store, "store_sales", found["store_sales"])), STORE_PARTS)
        store.replace("files", found["files"])
    return counts
