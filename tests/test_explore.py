"""Explorer views on small hand-made tables (JavaScript-like keys and
measures), paging and shares."""

from pyspark.sql import functions as F

from tillroll.operators import catalog as K, explore as X, inventory as I


def test_group_measure_keys_and_measures(spark):
    df = spark.createDataFrame(
        [("a", "3", 2.0), ("a", "x", 0.0), ("", "1,000", 3.0), (None, None, None), ("b", "2.5", 0.0)],
        "k string, v string, n double")
    s = {r.key: r.value for r in X.group_measure(df, "k", "v", "sum").collect()}
    assert s == {"a": 3.0, "(없음)": 1000.0, "b": 2.5}
    m = {r.key: r.value for r in X.group_measure(df, "k", "v", "max").collect()}
    assert m["(없음)"] == 1000.0 and m["a"] == 3.0
    a = {r.key: r.value for r in X.group_measure(df, "k", "v", "avg").collect()}
    assert a["a"] == 1.5 and a["(없음)"] == 500.0
    c = {r.key: r.value for r in X.group_measure(df, "k", X.COUNT_MEASURE, "count").collect()}
    assert c == {"a": 2.0, "(없음)": 2.0, "b": 1.0}
    nk = {r.key: r.value for r in X.group_measure(df, "n", X.COUNT_MEASURE, "sum").collect()}
    assert nk == {"2": 1.0, "(없음)": 3.0, "3": 1.0}
    ranks = [r.rank for r in X.group_measure(df, "k", "v", "sum", top=2).orderBy("rank").collect()]
    assert ranks == [1, 2]


def test_roles_profile_top_items(spark):
    df = spark.createDataFrame([("p", "1", 2, None), ("", "x", 3, None)],
                               "`상품명` string, t string, q int, e double")
    roles = {r.column_name: (r.is_numeric, r.is_text) for r in X.column_roles(df).collect()}
    assert roles == {"상품명": (False, True), "t": (True, True), "q": (True, False),
                     "e": (False, False)}
    prof = {(r.stat, r.column_name): r.value for r in X.profile(df).collect()}
    assert prof == {("rows", None): 2.0, ("columns", None): 4.0, ("sum", "q"): 5.0}
    items = {r.name: r.value for r in X.top_items(df, "q", name_col="상품명").collect()}
    # an empty name falls back to the first column, here the (empty) name itself
    assert items == {"p": 2.0, "": 3.0}
    items2 = {r.name: r.value for r in X.top_items(df.select("t", "상품명", "q"), "q",
                                                   name_col="상품명").collect()}
    assert items2 == {"p": 2.0, "x": 3.0}


def test_monthly_view(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", None, 1.0)], "name string, `1월` double, `3월` double")
    rows = X.monthly_view(df).orderBy("position").collect()
    assert [r.qty for r in rows] == [1.0, 0.0, 4.0] + [0.0] * 9 + [5.0]
    assert [r.share for r in rows][:3] == [20.0, 0.0, 80.0] and rows[-1].share == 100.0
    assert X.monthly_view(df.select("name")).count() == 0


def test_page_and_share(spark):
    df = spark.range(0, 123).withColumn("v", F.col("id") % 7)
    assert X.page(df, ["id"], 3, 50).count() == 23
    assert [r.id for r in X.page(df, ["id"], 2, 50).limit(2).collect()] == [50, 51]
    assert X.page_count(df, 50).first().pages == 3
    sh = X.with_share(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double"), "v")
    assert {r.k: r.share for r in sh.collect()} == {"a": 25.0, "b": 75.0}


def test_catalog_and_stock_edges(spark):
    imgs = spark.createDataFrame(
        [("o2", "1", "n1", "b", "u"), ("o1", "1", "n0", "b", "u"), ("o1", "1", "n2", "b", "u"),
         (None, "2", "m", "b", "u")], "supplier_option string, product_code string, "
        "product_name string, barcode string, image_url string")
    g = {r.product_code: r for r in K.catalog_groups(imgs).collect()}
    assert g["1"].supplier_option == "o1,o2" and g["1"].option_count == 3 and g["1"].product_name == "n0"
    assert g["2"].supplier_option is None
    assert K.search_catalog(imgs, "").count() == 0
    inv = spark.createDataFrame([("1", "o1", 5, 1, "x"), ("1", "o1", 7, 0, "x"), ("1", "o9", 0, 0, "y")],
                                "product_code string, supplier_option string, normal_stock int, "
                                "available_stock int, product_name string")
    one = {r.supplier_option: r.normal_stock for r in
           K.product_options_with_stock(imgs, inv, "1", one_per_option=True).collect()}
    assert one == {"o1": 7, "o2": 0}
    fan = K.product_options_with_stock(imgs, inv, "1").collect()
    assert len(fan) == 5  # two o1 catalog rows x two o1 stock rows + o2
    roll = K.option_rollup(K.product_options_with_stock(imgs, inv, one_per_option=True)).collect()
    assert {r.product_code: (r.option_count, r.total_stock, r.soldout_options) for r in roll} == {
        "1": (3, 14, 1), "2": (1, 0, 1)}
    s = I.inventory_summary(inv).first()
    assert (s.total_products, s.in_stock, s.out_of_stock, s.total_normal_stock) == (3, 2, 1, 12)
    neg = inv.union(spark.createDataFrame([("2", "o5", -1, 0, "z")], inv.schema))
    assert I.inventory_summary(neg).first().out_of_stock == 1
    assert I.inventory_summary(neg, out_of_stock="not_in_stock").first().out_of_stock == 2
    assert [r.normal_stock for r in I.low_stock(inv, 6).collect()] == [5]
    assert I.inventory_list(inv, keyword="Y").count() == 1


def test_catalog_listing_form(spark):
    imgs = spark.createDataFrame(
        [("A1", "1", "a", "b", "u1"), ("A", "1", "b", "b", "u2"), ("B", "1", "c", "b", "u3"),
         ("", "1", "d", "b", "u4"), ("X", "2", "z", "b", "u5")],
        "supplier_option string, product_code string, product_name string, barcode string, "
        "image_url string")
    got = {r.product_code: (r.product_name, r.supplier_option, r.image_url, r.option_count)
           for r in K.catalog_listing(imgs).collect()}
    assert got == {"1": ("a", "A1, B", "u1", 4), "2": ("z", "X", "u5", 1)}
