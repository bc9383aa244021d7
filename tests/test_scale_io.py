"""Writers whose disk and task sizes grow with the input."""
import glob
import gzip
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillroll.operators import maintain as M
from tillroll.plans.fixtures import Fixtures
from tillroll.schemas import STORE_SALES_SCHEMA
from tillroll.session import WRITE_SPLIT, local_path, small_splits, work_path
from tillroll.sources import export as X, ingest as G, snapshots as SN
from tillroll.sources.row_ids import with_row_ids
from tillroll.sources.store import TableStore
from tillroll.streaming import chunks as CH


def _lines(spark, n, chunk=10):
    return spark.range(n).select(F.floor(F.col("id") / chunk).alias("_chunk"), F.concat(F.lit("p"), "id").alias("상품명"),
                                 F.lit("a").alias("매장명"), F.lit(None).cast("string").alias("분류명"))


def test_chunk_files_are_compressed_and_bounded(spark):
    root = work_path(spark, "test-docs")
    CH.write_chunks(_lines(spark, 1500), root, 7, "monthly", "_chunk", ["상품명", "매장명", "분류명"])
    files = glob.glob(os.path.join(local_path(root), "*.json*"))
    docs = [len(gzip.open(f).readlines()) for f in files]  # fails on plain text
    assert sum(docs) == 150 and max(docs) <= CH.DOCUMENTS_PER_FILE
    rows = spark.read.schema(CH.CHUNK_SCHEMA).json(root).select(F.explode("rows").alias("r")).select("r.상품명", "r.분류명")
    assert rows.count() == 1500 and rows.distinct().count() == 1500


def test_rows_of_a_batch_are_neither_dealt_nor_kept(spark):
    root = work_path(spark, "test-lean")
    CH.write_chunks(_lines(spark, 60), f"{root}/in", 7, "monthly", "_chunk", ["상품명", "매장명", "분류명"])
    docs = CH.placed(spark.read.schema(CH.CHUNK_SCHEMA).json(f"{root}/in"))
    twice = docs.unionByName(docs.withColumn("_src", F.concat("_src", F.lit("z"))).withColumn("_at", F.col("_at") + 1000))
    kept = CH.latest_chunks(twice.drop("rows"))
    assert "rows" not in kept.columns
    assert kept.count() == 6 and kept.filter("_at < 1000").count() == 0  # the later file wins
    paths = CH.run_chunk_upload(spark, f"{root}/in", f"{root}/t")
    ledger = CH.read_ledger(spark, paths)
    assert {(r.chunk_index, r.inserted) for r in ledger.collect()} == {(k, 10) for k in range(6)}
    assert CH.staged_rows(spark, paths, "store_sales").count() == 60


def test_row_ids_leave_the_lines_where_they_are(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        out, n = with_row_ids(TableStore(spark), "t", spark.range(100).select(F.col("id").alias("x")))
        assert n == 100 and sorted(r.id for r in out.collect()) == list(range(1, 101))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_snapshot_files_are_compressed(spark):
    fx, path = Fixtures(spark, SF_SMALL), work_path(spark, "test-snap")
    lines = G.conform(fx.store_sales, STORE_SALES_SCHEMA)
    X.snapshot(path, lines.limit(0), lines)
    files = [f for f in glob.glob(os.path.join(local_path(path), "store_sales", "part-*"))]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert X.read_snapshot(spark, path, "store_sales").exceptAll(lines).count() == 0


def test_a_link_is_written_by_the_tasks_that_read_the_store(spark):
    store, root = TableStore(spark), work_path(spark, "test-chain")
    rows = spark.range(40).select(F.lit(1).cast("int").alias("file_id"), F.col("id").cast("double").alias("sold_qty"))
    for _ in range(3):
        store.append(M.SALES, G.conform(rows, SN._tables()["sales"][0]), ["file_id"])
    SN.take_snapshot(store, root)
    held = spark.read.parquet(f"{root}/000001/sales")
    assert held.count() == 120 and len(held.inputFiles()) > 1  # one partition, not one task


def test_small_splits_are_given_back(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    with small_splits(spark):
        with small_splits(spark):
            assert int(spark.conf.get(key)) <= WRITE_SPLIT
        assert int(spark.conf.get(key)) <= WRITE_SPLIT
    assert spark.conf.get(key) == old
    spark.conf.set(key, "1m")
    try:
        with small_splits(spark):
            assert int(spark.conf.get(key)) == 1 << 20
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, old)
