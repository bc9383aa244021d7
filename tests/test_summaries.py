"""Bitmap summaries, trigram search and snapshot chains against the plain
operators."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from test_plans import plan_text
from tillroll.operators import maintain as M, sales as S, summary as SM
from tillroll.plans.fixtures import Fixtures
from tillroll.schemas import INVENTORY_SCHEMA, SALES_SCHEMA, STORE_SALES_SCHEMA
from tillroll.session import work_path
from tillroll.sources import ingest as G, snapshots as SN
from tillroll.sources.postings import SearchIndex
from tillroll.sources.store import TableStore


@pytest.fixture(scope="module")
def store(spark):
    fx, store = Fixtures(spark, SF_SMALL), TableStore(spark)
    store.replace(M.SALES, G.conform(fx.sales, SALES_SCHEMA), ["file_id"])
    lines = G.conform(fx.store_sales, STORE_SALES_SCHEMA)
    store.replace(M.STORE_SALES, G.store_layout(lines.withColumn(
        "sale_date", F.when(F.col("sold_qty") != 7, F.col("sale_date")))), G.STORE_PARTS)
    SM.summarise_files(store, [1, 2, 3, 4])
    SM.summarise_files(store, [3])  # again: takes its own place
    M.delete_file(store, 2)
    M.delete_year(store, 1996, None)
    return store


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("file_id", [None, 3, 2])
def test_summaries_equal_the_lines(store, file_id):
    sales, lines = store.read(M.SALES, SALES_SCHEMA), store.read(M.STORE_SALES, STORE_SALES_SCHEMA)
    assert _rows(SM.weekly_sales(store, file_id)) == _rows(S.weekly_sales(lines, file_id))
    assert _rows(SM.monthly_sales(store, file_id)) == _rows(S.monthly_sales(lines, file_id))
    assert _rows(SM.summary_stats(store, file_id)) == _rows(S.summary_stats(sales, file_id))
    assert _rows(SM.sales_by(store, "category", file_id)) == _rows(S.sales_by_category(sales, file_id))


@pytest.fixture(scope="module")
def index(spark):
    fx = Fixtures(spark, SF_SMALL)
    odd = [(None, "x"), ("", "y"), ("a", "z"), ("Ab", "%_"), ("abc", None), ("100%_x", "é한글 é")]
    rows = G.conform(fx.inventory, INVENTORY_SCHEMA).unionByName(G.conform(
        spark.createDataFrame(odd, "product_name string, product_code string"), INVENTORY_SCHEMA))
    out = SearchIndex(spark, INVENTORY_SCHEMA, ["product_name", "product_code"])
    assert out.save(rows) == rows.count()
    return out, rows


@pytest.mark.parametrize("word", ["red", "RED ", "a", "Ab", "%_", "é", "한", "글 é", "00", "no such thing", "", "x", "antique"])
def test_search_equals_the_scan(index, word):
    out, rows = index
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(word.lower()), F.lit(False))
    want = rows.filter(has("product_name") | has("product_code")) if word else rows.limit(0)
    assert _rows(out.search(word)) == _rows(want)


def test_search_reads_postings_and_candidates(index):
    out, _ = index
    assert "PushedFilters: [In(piece" in plan_text(out.candidates("anti"))
    assert "StringStartsWith(piece,an)" in plan_text(out.candidates("an"))
    assert "PushedFilters: [In(id" in plan_text(out.search("red"))


def test_a_chain_of_snapshots(spark):
    fx, store = Fixtures(spark, SF_SMALL), TableStore(spark)
    root = work_path(spark, "chain")
    with pytest.raises(FileNotFoundError):
        SN.restore_link(store, root)
    lines = G.conform(fx.store_sales, STORE_SALES_SCHEMA)
    again = lines.filter("file_id = 1 and sold_qty > 30")
    states = []
    store.append(M.STORE_SALES, G.store_layout(lines), G.STORE_PARTS)
    for change in (lambda: None, lambda: M.delete_year(store, 1994, None),
                   lambda: store.append(M.STORE_SALES, G.store_layout(again.union(again)), G.STORE_PARTS)):
        change()
        SN.take_snapshot(store, root)
        states.append(_rows(store.read(M.STORE_SALES, STORE_SALES_SCHEMA)))
    new = [SN.manifest(spark, root, k).filter(f"table_name = 'store_sales' and link = {k}").count() for k in (1, 2, 3)]
    assert new[1] == 0 and 0 < new[2] < new[0]  # a deletion writes nothing, an append its partitions
    for k, want in enumerate(states, 1):
        other = TableStore(spark)
        counts = SN.restore_link(other, root, k)
        assert counts["store_sales"] == len(want) and _rows(other.read(M.STORE_SALES, STORE_SALES_SCHEMA)) == want
    # a link whose data is not what its manifest says is refused
    one = SN.read_link(spark, root, 1, "store_sales").limit(5).withColumn("_part", F.lit("1-1993"))
    one.write.partitionBy("_part").mode("append").parquet(f"{root}/000001/store_sales")
    with pytest.raises(ValueError):
        SN.restore_link(other, root, 1)
    assert _rows(other.read(M.STORE_SALES, STORE_SALES_SCHEMA)) == states[2]
