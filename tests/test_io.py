"""Sources, sinks, streaming and maintenance on scratch folders."""

import glob
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillroll.operators import maintain as M
from tillroll.plans.clean_queries import raw_sales_file, raw_stock_file
from tillroll.plans.fixtures import Fixtures
from tillroll.schemas import FILES_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
from tillroll.session import work_path
from tillroll.sources import export as X, ingest as G
from tillroll.sources.store import TableStore
from tillroll.streaming import chunks as CH


def test_header_rules():
    cat = G.resolve_headers(["대표상품코드", "상품코드", "상품명", "공급처 옵션", "바코드", "상품코드2"],
                            G.CATALOG_RULES)
    assert cat == {"product_code": "상품코드", "product_name": "상품명",
                   "supplier_option": "공급처 옵션", "barcode": "바코드"}
    stock = G.resolve_headers(["상품코드", "공급처", "공급처 옵션", "공급처상품명", "상품명", "옵션",
                               "정상재고", "가용재고", "품절여부", "판매가", "공급가"], G.STOCK_RULES)
    assert stock["supplier"] == "공급처" and stock["supplier_option"] == "공급처 옵션"
    assert stock["product_name"] == "상품명" and stock["option_name"] == "옵션"


def test_cp949_csv_and_sheets(spark):
    d = tempfile.mkdtemp(prefix="tillroll-io-")
    with open(os.path.join(d, "a.csv"), "w", encoding="cp949") as f:
        f.write("매장명,분류명,상품명,판매량,판매일자\n매장1,상의(업체),BJK001_[L]조끼,\"1,200\",2024/01/05\n"
                "매장수 2,상의,x,1,45292\n")
    with open(os.path.join(d, "b.csv"), "w", encoding="cp949") as f:
        f.write("상품명,매장명,판매량,판매일자\n바지,매장2,3,45292\n")
    raw = G.read_sheets(spark, {"의류 시트": os.path.join(d, "a.csv"),
                                "Shoes": os.path.join(d, "b.csv")}, encoding="cp949")
    out = G.clean_store_sales(raw, 7).orderBy("store").collect()
    assert [(r.store, r.data_type, r.sold_qty, str(r.sale_date)) for r in out] == [
        ("매장1", "의류", 1200.0, "2024-01-05"), ("매장2", "신발", 3.0, "2024-01-01")]
    assert out[0].category == "상의" and out[0].supplier == "업체"


def test_chunk_replay_is_idempotent(spark):
    fx = Fixtures(spark, SF_SMALL)
    lines = fx.raw_lines.select(F.floor(F.col("l_orderkey") / 100).alias("_chunk"),
                                F.col("classification").alias("분류명"),
                                F.col("product_name").alias("상품명"), F.col("qty_text").alias("판매량"))
    root = work_path(spark, "test-chunks")
    CH.write_chunks(lines, f"{root}/in1", 3, "original", "_chunk", ["분류명", "상품명", "판매량"])
    paths = CH.run_chunk_upload(spark, f"{root}/in1", f"{root}/t", checkpoint=f"{root}/ck1")
    n1 = spark.read.parquet(paths["sales"]).count()
    # the same chunks sent again (new files, new stream) replace themselves
    CH.write_chunks(lines, f"{root}/in2", 3, "original", "_chunk", ["분류명", "상품명", "판매량"])
    CH.run_chunk_upload(spark, f"{root}/in2", f"{root}/t", checkpoint=f"{root}/ck2")
    n2 = spark.read.parquet(paths["sales"]).count()
    assert n1 == n2 == G.clean_sales(raw_sales_file(fx), 3).count()
    # a rerun over the same folder and checkpoint finds nothing new
    CH.run_chunk_upload(spark, f"{root}/in1", f"{root}/t", checkpoint=f"{root}/ck1")
    assert spark.read.parquet(paths["sales"]).count() == n1
    # the complete file folds into the fact table; doing it twice changes nothing
    store = TableStore(spark)
    CH.finalize_uploads(spark, paths, store)
    CH.finalize_uploads(spark, paths, store)
    assert store.read(M.SALES, SALES_SCHEMA).count() == n1


def test_incomplete_upload_is_not_finalized(spark):
    fx = Fixtures(spark, SF_SMALL)
    lines = fx.raw_lines.select(F.floor(F.col("l_orderkey") / 100).alias("_chunk"),
                                F.col("product_name").alias("상품명"))
    root = work_path(spark, "test-partial")
    CH.write_chunks(lines, f"{root}/all", 4, "original", "_chunk", ["상품명"])
    docs = spark.read.schema(CH.CHUNK_SCHEMA).json(f"{root}/all")
    # the client stops after the first chunk
    docs.filter("chunk_index = 0").write.json(f"{root}/in")
    paths = CH.run_chunk_upload(spark, f"{root}/in", f"{root}/t")
    store = TableStore(spark)
    CH.finalize_uploads(spark, paths, store)
    assert store.current_version(M.SALES) is None


def test_file_registry_and_maintenance(spark):
    fx = Fixtures(spark, SF_SMALL)
    store = TableStore(spark)
    a = M.register_file(store, "a.csv", "a.csv", "original")
    b = M.register_file(store, "b.csv", "b.csv", "monthly")
    assert (a, b) == (1, 2)
    raw = raw_sales_file(fx)
    n = G.save_sales(store, raw, a)
    assert n == G.clean_sales(raw, a).count() > 0
    store.append(M.STORE_SALES, G.store_layout(G.conform(fx.store_sales, STORE_SALES_SCHEMA)
                 .withColumn("file_id", F.lit(b))), G.STORE_PARTS)
    M.refresh_row_counts(store)
    files = {r.id: r for r in store.read(M.FILES, FILES_SCHEMA).collect()}
    assert files[a].row_count == n and files[b].row_count == fx.store_sales.count()
    M.set_file_period(store, a, "2024 Q1")
    assert store.read(M.FILES, FILES_SCHEMA).filter("id = 1").first().data_period == "2024 Q1"
    deleted = {r.table_name: r.deleted for r in M.delete_year(store, 1996, None).collect()}
    assert deleted["sales"] == 0 and deleted["store_sales"] > 0
    assert store.read(M.STORE_SALES, STORE_SALES_SCHEMA).filter(F.year("sale_date") == 1996).count() == 0
    M.delete_file(store, a)
    assert store.read(M.SALES, SALES_SCHEMA).count() == 0
    active = [r.id for r in M.active_files(store.read(M.FILES, FILES_SCHEMA)).collect()]
    assert active == [b]
    M.reset_all(store)
    assert store.read(M.STORE_SALES, STORE_SALES_SCHEMA).count() == 0
    assert store.read(M.FILES, FILES_SCHEMA).count() == 0


def test_catalog_and_stock_loads(spark):
    fx = Fixtures(spark, SF_SMALL)
    store = TableStore(spark)
    n = G.load_inventory(store, raw_stock_file(fx))
    assert n == fx.inventory.filter("normal_stock <> 7").count() > 0
    d = tempfile.mkdtemp(prefix="tillroll-cat-")
    with open(os.path.join(d, "c.csv"), "w", encoding="utf-8") as f:
        f.write("상품코드,상품명,공급처 옵션,바코드\n881,조끼 L ,SO1 L,880\n,없음,SO2,1\n12,바지,,2\n")
    m = G.load_catalog(store, G.read_delimited(spark, d), "base/")
    rows = store.read("product_images", G.PRODUCT_IMAGES_SCHEMA).collect()
    assert m == 1 and rows[0].product_code == "00881" and rows[0].image_url == "base/00881_500.png"
    assert rows[0].product_name == "조끼 L"


def test_export_and_snapshot(spark):
    fx = Fixtures(spark, SF_SMALL)
    path = work_path(spark, "test-report")
    out = X.save_report({"a": fx.sales.limit(10), "b": fx.store_sales.limit(5)}, path)
    assert set(out) == {"a", "b"}
    from tillroll.session import local_path
    assert glob.glob(os.path.join(local_path(out["a"]), "*.csv"))
    snap = work_path(spark, "test-snap")
    files = spark.createDataFrame([(1, "f", "f", "original", 3, None, "active", None),
                                   (2, "g", "g", "original", 3, None, "deleted", None)], FILES_SCHEMA)
    X.snapshot(snap, G.conform(fx.sales, SALES_SCHEMA), G.conform(fx.store_sales, STORE_SALES_SCHEMA),
               files)
    assert X.read_snapshot(spark, snap, "files").count() == 1
    back = X.read_snapshot(spark, snap, "sales")
    assert back.schema == SALES_SCHEMA
    assert back.exceptAll(G.conform(fx.sales, SALES_SCHEMA)).count() == 0
    store = TableStore(spark)
    counts = X.restore_snapshot(store, snap)
    assert counts == {"sales": fx.sales.count(), "store_sales": fx.store_sales.count(), "files": 1}
    assert store.read(M.FILES, FILES_SCHEMA).first().id == 1


def test_chunk_numbers_and_unknown_headers(spark):
    import json

    from tillroll.session import local_path

    root = work_path(spark, "test-json-chunk")
    in_dir = local_path(root + "/in")
    os.makedirs(in_dir, exist_ok=True)
    doc = {"file_id": 9, "file_type": "monthly", "chunk_index": 0, "total_chunks": 1,
           "original_name": "m.xlsx", "data_type": "신발",
           "rows": [{"판매일자": 45292, "매장명": "매장1", "분류명": "운동화(업체A)", "판매량": 1200,
                     "모르는열": "x", "실판매금액": "1,234.5"},
                    {"판매일자": "2024-02-01", "매장명": "매장수 합계", "판매량": 1}]}
    with open(os.path.join(in_dir, "c0.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps(doc, ensure_ascii=False) + "\n")
    paths = CH.run_chunk_upload(spark, root + "/in", root + "/t")
    rows = spark.read.parquet(paths["store_sales"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.sold_qty, str(r.sale_date), r.data_type, r.category, r.supplier, r.file_id) == (
        1200.0, "2024-01-01", "신발", "운동화", "업체A", 9)
    assert float(r.net_sales) == 1234.5


def test_tsv_export_and_named_datasets(spark):
    d = tempfile.mkdtemp(prefix="tillroll-tsv-")
    with open(os.path.join(d, "x.xls"), "w", encoding="utf-8") as f:
        f.write("분류명\t상품명\t판매량\t실판매금액\n상의(업체)\tBJK001_[L]조끼\t2\t1,500\n")
    raw = G.read_tsv_or_csv(spark, os.path.join(d, "x.xls"))
    row = G.clean_sales(raw, 1).first()
    assert (row.category, row.supplier, row.sold_qty, float(row.net_sales)) == ("상의", "업체", 2.0, 1500.0)
    fx = Fixtures(spark, SF_SMALL)
    builders = X.export_builders(fx.sales, fx.store_sales, file_id=1)
    assert sorted(builders) == sorted(["supplier", "category", "products", "daily", "weekly",
                                       "store", "matrix", "monthly"])
    assert all(b().limit(1).count() == 1 for b in builders.values())


def test_same_chunk_twice_in_one_batch(spark):
    fx = Fixtures(spark, SF_SMALL)
    lines = fx.raw_lines.select(F.floor(F.col("l_orderkey") / 100).alias("_chunk"),
                                F.col("product_name").alias("상품명"))
    root = work_path(spark, "test-dup")
    CH.write_chunks(lines, f"{root}/a", 6, "original", "_chunk", ["상품명"])
    docs = spark.read.schema(CH.CHUNK_SCHEMA).json(f"{root}/a")
    # two copies of every chunk, in different files, processed in one batch
    docs.write.json(f"{root}/in/first")
    docs.write.json(f"{root}/in/second")
    spark.read.schema(CH.CHUNK_SCHEMA).json(f"{root}/in/first").write.mode("append").json(f"{root}/in2")
    spark.read.schema(CH.CHUNK_SCHEMA).json(f"{root}/in/second").write.mode("append").json(f"{root}/in2")
    paths = CH.run_chunk_upload(spark, f"{root}/in2", f"{root}/t")
    want = G.clean_sales(lines.drop("_chunk"), 6).count()
    assert spark.read.parquet(paths["sales"]).count() == want


def test_load_file_lifecycle(spark):
    d = tempfile.mkdtemp(prefix="tillroll-load-")
    with open(os.path.join(d, "s.csv"), "w", encoding="cp949") as f:
        f.write("분류명,상품명,판매량,실판매금액\n상의(업체),BJK001_[L]조끼,2,\"1,500\"\n합계,3 row(s),9,9\n")
    with open(os.path.join(d, "m.csv"), "w", encoding="cp949") as f:
        f.write("판매일자,매장명,분류명,상품명,판매량\n45292,매장1,하의(B),바지,1\n45293,매장수 1,하의,x,1\n")
    store = TableStore(spark)
    a = G.load_file(store, os.path.join(d, "s.csv"), "original", "s.csv", encoding="cp949")
    b = G.load_file(store, {"의류": os.path.join(d, "m.csv")}, "monthly", "m.xlsx", encoding="cp949")
    assert a == (1, 1, 0) and b == (2, 1, 0)
    files = {r.id: (r.file_type, r.row_count) for r in store.read(M.FILES, FILES_SCHEMA).collect()}
    assert files == {1: ("original", 1), 2: ("monthly", 1)}
    st = store.read(M.STORE_SALES, STORE_SALES_SCHEMA).first()
    assert (st.data_type, str(st.sale_date), st.category) == ("의류", "2024-01-01", "하의")


def _days(spark, rows):
    return G.store_layout(G.conform(spark.createDataFrame(rows, "file_id int, sale_date date"), STORE_SALES_SCHEMA))


def _left(store):
    return sorted((r.file_id, str(r.sale_date)) for r in store.read(M.STORE_SALES, STORE_SALES_SCHEMA).collect())


def test_year_delete_rewrites_nothing(spark):
    import datetime as dt

    from tillroll.session import local_path

    rows = [(1, dt.date(2024, 3, 1)), (2, dt.date(2023, 1, 1)), (2, dt.date(2024, 1, 1)), (3, None)]
    store = TableStore(spark)
    store.replace(M.STORE_SALES, _days(spark, rows), G.STORE_PARTS)
    files = lambda: sorted(glob.glob(local_path(store.path(M.STORE_SALES, 1)) + "/**/*.parquet", recursive=True))
    before = files()
    out = {r.table_name: r.deleted for r in M.delete_year(store, 2024).collect()}
    assert out == {"store_sales": 2, "sales": 0} and files() == before
    assert _left(store) == [(2, "2023-01-01"), (3, "None")]
    # lines loaded later into the deleted year and into a deleted file show
    store.append(M.STORE_SALES, _days(spark, [(2, dt.date(2024, 6, 1))]), G.STORE_PARTS)
    M.delete_file(store, 2)
    assert _left(store) == [(3, "None")]
    store.append(M.STORE_SALES, _days(spark, [(2, dt.date(2024, 7, 1))]), G.STORE_PARTS)
    assert _left(store) == [(2, "2024-07-01"), (3, "None")]
    assert {r.sale_date.year for r in G.stored_between(store, "2024-01-01", "2024-12-31").collect()} == {2024}


def test_many_drops_are_joined(spark, monkeypatch):
    from tillroll.sources import store as S

    monkeypatch.setattr(S, "PRUNED_DROPS", 1)
    import datetime as dt

    store = TableStore(spark)
    store.replace(M.STORE_SALES, _days(spark, [(k, dt.date(2020, 1, 1)) for k in range(5)]), G.STORE_PARTS)
    store.drop_partitions(M.STORE_SALES, "file_id", [1, 3])
    store.append(M.STORE_SALES, _days(spark, [(3, dt.date(2021, 1, 1))]), G.STORE_PARTS)
    assert _left(store) == [(0, "2020-01-01"), (2, "2020-01-01"), (3, "2021-01-01"), (4, "2020-01-01")]


def test_two_handles_and_lost_logs(spark):
    import datetime as dt
    import shutil

    from tillroll.session import local_path
    from tillroll.sources.store import VersionConflict

    a = TableStore(spark)
    a.replace(M.STORE_SALES, _days(spark, [(1, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    b = TableStore(spark, a.root)
    b.replace(M.STORE_SALES, _days(spark, [(2, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    a.append(M.STORE_SALES, _days(spark, [(3, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    assert _left(b) == [(2, "2020-01-01"), (3, "2020-01-01")]

    class Late(TableStore):  # another handle replaces the table during this one's write
        def _write(self, *args):
            super()._write(*args)
            b.replace(M.STORE_SALES, _days(spark, [(9, dt.date(2020, 1, 1))]), G.STORE_PARTS)

    with pytest.raises(VersionConflict):
        Late(spark, a.root).append(M.STORE_SALES, _days(spark, [(4, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    assert _left(a) == [(9, "2020-01-01")]
    # an unreadable log is an error, not an empty table
    log = local_path(f"{a.root}/{M.STORE_SALES}/_versions")
    shutil.copytree(log, log + "_copy")
    for f in glob.glob(log + "/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"no parquet")
    with pytest.raises(Exception):
        a.append(M.STORE_SALES, _days(spark, [(5, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    with pytest.raises(Exception):
        a.current_version(M.STORE_SALES)


def test_restore_from_a_wrong_path_changes_nothing(spark):
    import datetime as dt

    store = TableStore(spark)
    store.replace(M.STORE_SALES, _days(spark, [(1, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    with pytest.raises(FileNotFoundError):
        X.restore_snapshot(store, work_path(spark, "nowhere"))
    half = work_path(spark, "half")
    spark.createDataFrame([("sales", 5)], X.MANIFEST).write.json(f"{half}/manifest")
    with pytest.raises(ValueError):
        X.restore_snapshot(store, half)
    assert _left(store) == [(1, "2020-01-01")]


def test_vacuum_keeps_the_current_version(spark):
    import datetime as dt

    store = TableStore(spark)
    for k in range(3):
        store.replace(M.STORE_SALES, _days(spark, [(k, dt.date(2020, 1, 1))]), G.STORE_PARTS)
    assert len(store.vacuum(M.STORE_SALES)) == 2
    assert _left(store) == [(2, "2020-01-01")]


def _send(root, docs, name):
    import json

    from tillroll.session import local_path

    os.makedirs(local_path(root + "/in"), exist_ok=True)
    for k, doc in enumerate(docs):
        with open(os.path.join(local_path(root + "/in"), f"{name}{k}.json"), "w", encoding="utf-8") as f:
            f.write(json.dumps(doc, ensure_ascii=False) + "\n")


def _doc(index, rows, total=2, file_id=None):
    return {"file_id": file_id, "file_type": "original", "chunk_index": index, "total_chunks": total,
            "original_name": "up.xlsx", "data_type": None, "rows": [{"상품명": n, "판매량": "1"} for n in rows]}


def test_upload_without_ids_and_with_an_all_dropped_chunk(spark):
    root, store = work_path(spark, "test-ledger"), TableStore(spark)
    M.register_file(store, "older.csv", "older.csv", "original")

    def go():
        CH.run_chunk_upload(spark, root + "/in", root + "/t", checkpoint=root + "/ck", finalize_into=store)
        names = sorted(r.product_name for r in store.read(M.SALES, SALES_SCHEMA).collect())
        files = {r.id: (r.filename, r.file_type, r.row_count) for r in store.read(M.FILES, FILES_SCHEMA).collect()}
        return names, files[2]

    _send(root, [_doc(0, ["a", "b"])], "first")
    assert go() == ([], ("up.xlsx", "original", 2))          # not complete: counted, not folded in
    _send(root, [_doc(1, ["3 row(s)"], file_id=2)], "second")  # only summary lines
    assert go() == (["a", "b"], ("up.xlsx", "original", 2))
    _send(root, [_doc(0, ["7 row(s)"], file_id=2), _doc(1, ["c"], file_id=2)], "third")  # corrected chunks
    assert go() == (["c"], ("up.xlsx", "original", 1))


def test_reset_then_reuse_of_file_ids(spark):
    fx = Fixtures(spark, SF_SMALL)
    store = TableStore(spark)
    raw = raw_sales_file(fx)
    a = M.register_file(store, "a", "a", "original")
    G.save_sales(store, raw, a)
    M.delete_file(store, a)
    assert store.read(M.SALES, SALES_SCHEMA).count() == 0
    M.reset_all(store)
    b = M.register_file(store, "b", "b", "original")   # ids start again after a reset
    n = G.save_sales(store, raw, b)
    assert b == a and store.read(M.SALES, SALES_SCHEMA).count() == n > 0
    # a store opened fresh on the same folder sees the same state
    assert TableStore(spark, store.root).read(M.SALES, SALES_SCHEMA).count() == n


def test_stream_finalizes_as_chunks_complete(spark):
    fx = Fixtures(spark, SF_SMALL)
    lines = fx.raw_lines.select(F.floor(F.col("l_orderkey") / 100).alias("_chunk"),
                                F.col("product_name").alias("상품명"))
    root = work_path(spark, "test-final")
    CH.write_chunks(lines, f"{root}/all", 8, "original", "_chunk", ["상품명"])
    docs = spark.read.schema(CH.CHUNK_SCHEMA).json(f"{root}/all")
    store = TableStore(spark)
    docs.filter("chunk_index = 0").write.json(f"{root}/in")
    CH.run_chunk_upload(spark, f"{root}/in", f"{root}/t", checkpoint=f"{root}/ck",
                        finalize_into=store)
    assert store.read(M.SALES, SALES_SCHEMA).count() == 0          # not complete yet
    docs.filter("chunk_index > 0").write.mode("append").json(f"{root}/in")
    CH.run_chunk_upload(spark, f"{root}/in", f"{root}/t", checkpoint=f"{root}/ck",
                        finalize_into=store)
    assert store.read(M.SALES, SALES_SCHEMA).count() == G.clean_sales(lines.drop("_chunk"), 8).count()


def test_reset_and_custom_rows_run_over_whole_tables(spark, monkeypatch):
    from tillroll.operators import maintain
    from tillroll.plans import registry
    from tillroll.plans.fixtures import Fixtures
    from tillroll.schemas import FILES_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
    from tillroll.sources import export

    fx = Fixtures(spark, SF_SMALL)
    want = (fx.sales.count(), fx.store_sales.count(), 4)
    seen = []

    def watched(real):
        def run(store, *args, **kw):
            seen.append(tuple(store.read(n, k).count() for n, k in (
                ("sales", SALES_SCHEMA), ("store_sales", STORE_SALES_SCHEMA), ("files", FILES_SCHEMA))))
            return real(store, *args, **kw)
        return run

    monkeypatch.setattr(maintain, "reset_all", watched(maintain.reset_all))
    monkeypatch.setattr(export, "custom_rows", watched(export.custom_rows))
    queries = registry.queries()
    n = fx.sales.filter("file_id = 3").count()
    assert queries["reset_tables"](spark, SF_SMALL).count() == n
    assert queries["custom_rows"](spark, SF_SMALL).count() == fx.store_sales.filter("file_id = 2").count()
    assert seen == [want, want]
