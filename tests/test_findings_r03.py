"""What the findings of round 3 asked for: fewer and smaller shuffles and files."""

import glob
import os

import pytest

from tillroll.operators import drilldown as D, maintain as M, summary as SM
from tillroll.plans import io_queries
from tillroll.plans.fixtures import VIEW_DEPS, Fixtures
from tillroll.schemas import SALES_SCHEMA, STORE_SALES_SCHEMA
from tillroll.sources import export as X, ingest as G
from tillroll.sources.store import TableStore

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "R")]),
    "nation": ("n_nationkey int, n_name string", [(0, "N0"), (1, "N1")]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "BUILDING"), (121, 1, "MACHINERY"), (-5, 1, "FURNITURE")]),
    "supplier": ("s_suppkey long, s_name string", [(1, "S1"), (2, "S2"), (2, "S2b"), (None, "S0")]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int",
             [(k, f"part {k}", f"Brand#{k % 3}", f"TYPE {k % 2}", k) for k in range(12)] + [(None, "none", "Brand#1", "TYPE 1", 1)]),
    "orders": ("o_orderkey long, o_custkey long", [(k, (1, 121, -5, None)[k % 4]) for k in range(-3, 9)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_returnflag string, l_shipdate timestamp", None),
}


@pytest.fixture()
def fx(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        if rows is None:
            rows = [(k % 13 - 3, None if k == 7 else k % 14, None if k == 9 else 1 + k % 3, 1 + k % 7, float(k % 50), 10.25 * k,
                     0.05, "RAN"[k % 3], None) for k in range(200)]
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.selectExpr(*[c for c in df.columns if c != "l_shipdate"],
                               "timestamp'1995-12-30 10:00:00' + make_interval(0, 0, 0, cast(l_quantity as int)) as l_shipdate")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return Fixtures(spark, str(tmp_path))


@pytest.fixture()
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _below(plan, mark):
    """The plan lines under the first line with ``mark``."""
    at = next(k for k, x in enumerate(plan) if mark in x)
    deep = lambda x: len(x) - len(x.lstrip(" :+-|"))
    out = []
    for x in plan[at + 1:]:
        if deep(x) <= deep(plan[at]):
            break
        out.append(x)
    return out


@pytest.mark.parametrize("view", ["sales", "store_sales"])
def test_spark_view_has_the_rows_of_its_sql(fx, view):
    from tillroll.plans.fixtures import VIEW_SQL, duck_with  # the text that both engines may run
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{fx.sf_dir}/{name}.parquet/*.parquet'")
    assert VIEW_DEPS[view] and VIEW_SQL[view]
    want = con.execute(f"{duck_with([view])} select * from {view}").fetchall()
    got = [tuple(r) for r in fx.table(view).collect()]
    assert len(got) > 50 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_lines_are_not_shuffled_by_customer(fx, no_broadcast):
    assert not any("l_partkey" in x for x in _below(_plan(fx.store_sales), "Exchange hashpartitioning(o_custkey"))


@pytest.mark.parametrize("make", [D.supplier_category_matrix, D.matrix_export])
def test_leaves_are_not_shuffled_by_group(fx, no_broadcast, make):
    df = make(fx.sales)
    assert df.count() > 0
    assert not any("Exchange hashpartitioning" in x and "base_code" in x for x in _plan(df))


def test_report_makes_its_input_once(spark, fx, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    sales = G.conform(fx.sales, SALES_SCHEMA)
    X.combined_report(sales.mapInArrow(run, sales.schema), fx.store_sales, f"{tmp_path}/report")
    assert seen.value == sales.count() > 0


def test_sums_do_not_meet_the_dictionary(spark, fx, monkeypatch):
    store, plans = TableStore(spark), {}
    store.append(M.SALES, G.conform(fx.sales, SALES_SCHEMA), ["file_id"])
    store.append(M.STORE_SALES, G.store_layout(G.conform(fx.store_sales, STORE_SALES_SCHEMA)), G.STORE_PARTS)
    put = TableStore.replace_partitions

    def watched(self, table, df, *rest):
        plans[table] = "\n".join(_plan(df))
        return put(self, table, df, *rest)

    monkeypatch.setattr(TableStore, "replace_partitions", watched)
    SM.summarise_files(store, [1, 2, 3, 4])
    assert "Join" in plans["key_sets"] and "Join" not in plans["key_sums"] + plans["day_sums"]


@pytest.mark.parametrize("name", ["csv_load", "sheets_load"])
def test_exported_text_is_compressed(spark, fx, tmp_path, monkeypatch, name):
    monkeypatch.setattr(io_queries, "work_path", lambda spark, *parts: f"{tmp_path}/work")
    from tillroll.plans.registry import REGISTRY

    assert REGISTRY[name].build(fx).count() > 0
    files = [f for f in glob.glob(f"{tmp_path}/work/**/part-*", recursive=True) if os.path.isfile(f)]
    assert files and all(f.endswith(".csv.gz") for f in files)
