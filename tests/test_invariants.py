"""Cross-query invariants."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillroll.operators import drilldown as D, explore as X, sales as S
from tillroll.plans.fixtures import Fixtures


def test_supplier_totals_match_unlimited_a4(spark):
    fx = Fixtures(spark, SF_SMALL)
    h1 = D.supplier_category_matrix(fx.sales).select("supplier", "supplier_total").distinct()
    a4 = S.sales_by_supplier(fx.sales.filter(F.col("category").isNotNull()), top=None)
    got = {r.supplier: r.supplier_total for r in h1.collect()}
    want = {r.supplier: r.net_sales for r in a4.collect()}
    assert got == want


def test_group_cut_keeps_top_50(spark):
    fx = Fixtures(spark, SF_SMALL)
    h1 = D.supplier_category_matrix(fx.sales, top_groups=2)
    per = h1.groupBy("supplier", "category").agg(F.countDistinct("base_code").alias("g"),
                                                 F.max("group_rank").alias("r")).collect()
    assert all(r.g <= 2 and r.r <= 2 for r in per)


def test_day_week_month_sums_agree(spark):
    fx = Fixtures(spark, SF_SMALL)
    tot = [df.agg(F.sum("net_sales").alias("t"), F.sum("row_count").alias("n")).first()
           for df in (S.daily_sales(fx.store_sales), S.weekly_sales(fx.store_sales),
                      S.monthly_sales(fx.store_sales))]
    assert len({round(t.t, 2) for t in tot}) == 1 and len({t.n for t in tot}) == 1


def test_month_shares_sum_to_about_100(spark):
    fx = Fixtures(spark, SF_SMALL)
    rows = X.monthly_view(fx.wide_months).collect()
    assert len(rows) == 13
    assert abs(sum(r.share for r in rows if r.position <= 12) - 100) < 1.0
    assert rows[-1].qty == sum(r.qty for r in rows[:12])


def test_store_matrix_limits(spark):
    fx = Fixtures(spark, SF_SMALL)
    h2 = D.store_category_matrix(fx.store_sales, top_stores=5, top_products=3)
    assert h2.select("store").distinct().count() <= 5
    assert h2.agg(F.max("product_rank")).first()[0] <= 3


def test_summary_flags(spark):
    from decimal import Decimal

    from tillroll.schemas import SALES_SCHEMA
    from tillroll.sources.ingest import conform

    df = conform(spark.createDataFrame(
        [(1, "", "s", "c", Decimal("1.5"), 2.0), (1, "p", "", "c", Decimal("2.5"), 1.0)],
        "file_id int, product_code string, supplier string, category string, "
        "net_sales decimal(18,4), sold_qty double"), SALES_SCHEMA)
    a = S.summary_stats(df).first()
    assert (a.total_sales, a.unique_products, a.unique_suppliers) == (4.0, 2, 2)
    b = S.summary_stats(df, skip_empty_in_distinct=True).first()
    assert (b.unique_products, b.unique_suppliers, b.unique_categories) == (1, 1, 1)
    e = S.summary_stats(df, file_id=9).first()
    assert e.total_records == 0 and e.total_sales is None
    z = S.summary_stats(df, file_id=9, empty_sums_as_zero=True).first()
    assert (z.total_sales, z.total_qty) == (0.0, 0.0)
