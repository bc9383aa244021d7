"""Concurrent writers, row ids, keyed copies and uploads that end."""
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_plans import plan_text
from tillroll.operators import catalog as K, maintain as M
from tillroll.plans.clean_queries import raw_store_file
from tillroll.plans.fixtures import Fixtures
from tillroll.schemas import FILES_SCHEMA, STORE_SALES_SCHEMA
from tillroll.session import work_path
from tillroll.sources import ingest as G, keyed as KT
from tillroll.sources.claims import Claims
from tillroll.sources.row_ids import restored, stored_schema, with_row_ids
from tillroll.sources.store import TableStore


def test_eight_files_at_once_get_eight_ids(spark):
    store = TableStore(spark)
    M.register_file(store, "first", "first", "original")

    def load(k):
        fid = M.register_file(TableStore(spark, store.root), f"f{k}", f"f{k}", "original")
        M.set_row_count(store, fid, k)
        return fid

    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(load, range(8)))
    assert sorted(ids) == list(range(2, 10))
    rows = store.read(M.FILES, FILES_SCHEMA).collect()
    assert sorted((r.id, r.filename, r.row_count) for r in rows) == sorted(
        [(1, "first", 0), *[(i, f"f{k}", k) for k, i in enumerate(ids)]])


def test_a_claim_is_taken_once(spark):
    claims = Claims(spark, work_path(spark, "claims"))
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: claims.create_once(f"{claims.root}/x/one", str(k)), range(8)))
        firsts = list(pool.map(lambda k: claims.take("n", 5, k + 1), range(8)))
    assert sum(made) == 1 and claims.text(f"{claims.root}/x/one") == str(made.index(True))
    taken = sorted((a, k + 1) for k, a in enumerate(firsts))
    assert taken[0][0] == 5 and all(a + n == b for (a, n), (b, _) in zip(taken, taken[1:]))
    claims.forget("n")
    assert claims.take("n", 1) == 1


def test_a_turn_that_is_never_given_back_is_taken_over(spark):
    claims, order = Claims(spark, work_path(spark, "claims")), []
    with pytest.raises(RuntimeError), claims.turn("t"):
        raise RuntimeError  # given back all the same
    assert claims.create_once(f"{claims.root}/turns/t", "a writer that was lost")
    with claims.turn("t", lease=0.5):
        order.append(1)
    with claims.turn("t"):
        order.append(2)
    assert order == [1, 2] and claims.names(f"{claims.root}/turns") == []


def test_row_ids_are_dense_and_survive_a_restore(spark):
    fx, store = Fixtures(spark, SF_SMALL), TableStore(spark)
    lines = raw_store_file(fx).repartition(7)
    n = [G.save_store_sales(store, lines, fid) for fid in (1, 2)]
    stored = stored_schema(STORE_SALES_SCHEMA)
    rows = store.read(M.STORE_SALES, stored)
    by = {r.file_id: r for r in rows.groupBy("file_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    assert (by[1].a, by[1].b, by[2].a, by[2].b) == (1, n[0], n[0] + 1, sum(n))
    assert rows.select("id").distinct().count() == sum(n) and rows.filter("created_at is null").count() == 0
    # rows of an older snapshot, without ids
    plain = G.conform(fx.store_sales.limit(50), STORE_SALES_SCHEMA)
    none = plain.select(F.lit(None).cast("long").alias("id"), *plain.columns, F.lit(None).cast("timestamp").alias("created_at"))
    again = restored(store, M.STORE_SALES, none)
    assert sorted(r.id for r in again.collect()) == list(range(1, 51))
    assert with_row_ids(store, M.STORE_SALES, plain.limit(0))[1] == 0
    assert min(r.id for r in with_row_ids(store, M.STORE_SALES, plain)[0].collect()) == 51


@pytest.fixture(scope="module")
def keyed(spark):
    fx = Fixtures(spark, SF_SMALL)
    tables = KT.KeyedTables(spark, buckets=8)
    KT.save_catalog(tables, fx.product_images)
    tables.save("inventory_by_option", fx.inventory)
    return tables


def _ran(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def test_keyed_join_shuffles_neither_side(spark, keyed):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _ran(K.product_options_with_stock(keyed.open("catalog_by_option"), keyed.open("inventory_by_option"),
                                                 one_per_option=True))
    finally:
        spark.conf.set(conf, old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("copy,lookup", [("catalog_by_code", lambda t: K.image_by_code(t, "00007")),
                                         ("catalog_by_option", lambda t: K.image_by_option(t, "SO0007 SMALL"))])
def test_keyed_lookup_reads_one_bucket(spark, keyed, copy, lookup):
    conf = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(conf, "false")  # the plan then says which buckets are read
    try:
        assert re.search(r"SelectedBucketsCount: 1 out of 8", plan_text(lookup(keyed.open(copy))))
    finally:
        spark.conf.unset(conf)
    df = lookup(keyed.open(copy))
    assert df.collect() == lookup(Fixtures(spark, SF_SMALL).product_images).collect()
    # another session's view of the same folder
    other = KT.KeyedTables(spark, keyed.root, 8)
    assert lookup(other.open(copy)).collect() == df.collect()


def test_product_with_many_options_is_joined(spark, keyed):
    few, many = KT.options_of_product(keyed, "00007"), KT.options_of_product(keyed, "00007", most=0)
    assert few.collect() == many.collect() and few.count() > 0
