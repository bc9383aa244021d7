"""Plan-shape checks: no cartesian or nested-loop joins, no Python UDFs,
per-group top-N planned as WindowGroupLimit, filters reaching the scan."""

import contextlib
import io

import pytest

from conftest import SF_SMALL
from tillroll.operators import sales as S
from tillroll.plans import registry
from tillroll.plans.fixtures import Fixtures
from tillroll.schemas import SALES_SCHEMA
from tillroll.sources import ingest as G
from tillroll.sources.store import TableStore

QUERIES = registry.queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_operators(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    bad = [op for op in FORBIDDEN if op in text]
    assert not bad, bad


@pytest.mark.parametrize("name", ["supplier_category_matrix", "store_category_matrix"])
def test_top_n_is_window_group_limit(spark, name):
    assert "WindowGroupLimit" in plan_text(QUERIES[name](spark, SF_SMALL))


@pytest.mark.parametrize("name,scans", [("supplier_category_matrix", 1), ("matrix_export", 1),
                                        ("store_category_matrix", 2)])
def test_drilldowns_scan_the_lines_once(spark, name, scans):
    """On the plan that ran: the leaf aggregate is made once and reused (twice
    for the stores, whose broadcast list is made ahead of the rest)."""
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("l_extendedprice") > 0
    assert sum("FileScan parquet" in x and "l_orderkey" in x for x in plan.splitlines()) <= scans


def test_top_list_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan_text(QUERIES["sales_by_supplier"](spark, SF_SMALL))


def test_file_filter_prunes_stored_partitions(spark):
    fx = Fixtures(spark, SF_SMALL)
    store = TableStore(spark)
    store.replace("sales", G.conform(fx.sales, SALES_SCHEMA), ["file_id"])
    text = plan_text(S.sales_by_supplier(store.read("sales", SALES_SCHEMA), file_id=2))
    assert "PartitionFilters: [isnotnull(file_id" in text and "(file_id#" in text
    assert "ReadSchema: struct<supplier:string,product_code:string,sold_qty:double,net_sales" in text


def test_date_range_reaches_scan(spark):
    fx = Fixtures(spark, SF_SMALL)
    store = TableStore(spark)
    from tillroll.schemas import STORE_SALES_SCHEMA
    store.replace("store_sales", G.conform(fx.store_sales, STORE_SALES_SCHEMA), ["file_id"])
    df = S.daily_sales(store.read("store_sales", STORE_SALES_SCHEMA), start_date="1995-01-01")
    text = plan_text(df)
    pushed = [ln for ln in text.splitlines() if "PushedFilters" in ln]
    assert pushed and "GreaterThanOrEqual(sale_date,1995-01-01)" in pushed[0]
    assert "ReadSchema: struct<sale_date:date,sold_qty:double,net_sales" in text


def test_file_delete_prunes_instead_of_rewriting(spark):
    from tillroll.operators import maintain as M

    fx = Fixtures(spark, SF_SMALL)
    store = TableStore(spark)
    store.replace("sales", G.conform(fx.sales, SALES_SCHEMA), ["file_id"])
    version = store.current_version("sales")
    M.delete_file(store, 2)
    assert store.current_version("sales") == version  # no new data version
    df = store.read("sales", SALES_SCHEMA)
    text = plan_text(df)
    part = [ln for ln in text.splitlines() if "PartitionFilters" in ln]
    # the deleted file is a partition filter: its folder is never listed or read
    assert part and "NOT (file_id" in part[0] and "= 2)" in part[0]
    assert df.filter("file_id = 2").count() == 0
    assert df.count() == fx.sales.filter("file_id <> 2").count()
    # a later rewrite (year delete on the same store type) keeps the file gone
    reopened = TableStore(spark, store.root)
    assert reopened.read("sales", SALES_SCHEMA).filter("file_id = 2").count() == 0
