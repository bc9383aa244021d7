"""Chunked uploads, row ids and restores over larger tables: what is written
and read does not grow with the number of chunks, and no more often than needed."""
import glob
import os

from pyspark.sql import functions as F
from test_io import _doc, _send

from tillroll.operators import maintain as M
from tillroll.schemas import FILES_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
from tillroll.session import COMPILED_METHOD, local_path, small_splits, work_path
from tillroll.sources import export as X, row_ids as R
from tillroll.sources.row_ids import stored_schema
from tillroll.sources.store import TableStore
from tillroll.streaming import chunks as CH


def test_staging_does_not_grow_with_the_chunks(spark, monkeypatch):
    root, store = work_path(spark, "test-f2"), TableStore(spark)
    lines = spark.range(90).select(F.floor(F.col("id") / 10).alias("_chunk"), F.concat(F.lit("p"), "id").alias("상품명"))
    CH.write_chunks(lines, f"{root}/in", 7, "original", "_chunk", ["상품명"])
    monkeypatch.setattr(CH, "with_row_ids", None)  # the staged files are numbered as they are
    paths = CH.run_chunk_upload(spark, f"{root}/in", f"{root}/t", finalize_into=store)
    for name in ("sales", "ledger"):
        assert len(glob.glob(os.path.join(local_path(paths[name]), "file_id=7", "*"))) == 1
    assert len(glob.glob(os.path.join(local_path(paths["ledger"]), "file_id=7", "*", "part-*"))) == 1
    rows = store.read(M.SALES, stored_schema(SALES_SCHEMA)).select("id", "product_name").collect()
    assert sorted(r.id for r in rows) == list(range(1, 91))
    assert {r.product_name for r in rows} == {f"p{k}" for k in range(90)}
    assert {(r.chunk_index, r.inserted) for r in CH.read_ledger(spark, paths).collect()} == {(k, 10) for k in range(9)}
    assert store.read(M.FILES, FILES_SCHEMA).first().row_count == 90


def test_a_chunk_sent_again_beside_others(spark):
    root, store = work_path(spark, "test-f3"), TableStore(spark)

    def go(docs, name):
        _send(root, docs, name)
        paths = CH.run_chunk_upload(spark, root + "/in", root + "/t", checkpoint=root + "/ck", finalize_into=store)
        rows = store.read(M.SALES, stored_schema(SALES_SCHEMA)).select("id", "product_name").collect()
        ids = sorted(r.id for r in rows)
        assert ids == list(range(ids[0], ids[0] + len(ids)))  # dense
        batches = len(glob.glob(os.path.join(local_path(paths["sales"]), "file_id=7", "*")))
        return sorted(r.product_name for r in rows), CH.staged_rows(spark, paths, "sales").count(), batches

    assert go([_doc(0, ["a", "b"], file_id=7), _doc(1, ["c"], file_id=7)], "first") == (["a", "b", "c"], 3, 1)
    assert go([_doc(0, ["d"], file_id=7)], "second") == (["c", "d"], 2, 2)  # the first batch still holds c
    assert go([_doc(1, ["e", "f"], file_id=7)], "third") == (["d", "e", "f"], 3, 2)  # and now nothing: it is gone


def test_a_batch_written_again_changes_nothing(spark):
    root, store = work_path(spark, "test-f1"), TableStore(spark)
    _send(root, [_doc(0, ["a", "b"], file_id=7), _doc(1, ["c"], file_id=7)], "first")
    for k in range(2):  # another checkpoint: the same documents come again as a batch
        paths = CH.run_chunk_upload(spark, root + "/in", root + "/t", checkpoint=f"{root}/ck{k}", finalize_into=store)
        assert spark.read.parquet(paths["sales"]).count() == 3
        assert store.read(M.SALES, SALES_SCHEMA).count() == 3


def test_a_snapshot_is_read_once_before_it_is_restored(spark, monkeypatch):
    lines = spark.range(20).select("id", F.lit(1).alias("file_id"), F.col("id").cast("string").alias("store"))
    cols = [f.name for f in stored_schema(STORE_SALES_SCHEMA).fields]
    full = lines.select(*[F.col(c) if c in lines.columns else F.lit(None).cast(f.dataType).alias(c)
                          for c, f in zip(cols, stored_schema(STORE_SALES_SCHEMA).fields)])
    path, store, seen = work_path(spark, "test-f4"), TableStore(spark), []
    X.snapshot(path, full.select("id").limit(0), full)
    real = R.id_range
    for at in (X, R):
        monkeypatch.setattr(at, "id_range", lambda df: seen.append(1) or real(df))
    assert X.restore_snapshot(store, path)["store_sales"] == 20
    assert len(seen) == 3  # one reading a table
    back = store.read(M.STORE_SALES, stored_schema(STORE_SALES_SCHEMA))
    assert sorted(r.id for r in back.collect()) == list(range(20))
    assert store.claims.take(f"{M.STORE_SALES}-rows", 1) == 20


def test_writing_stages_are_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(key)
    with small_splits(spark):
        assert int(spark.conf.get(key)) == COMPILED_METHOD
    assert spark.conf.get(key) == old
