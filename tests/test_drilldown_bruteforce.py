"""The drill-downs against a plain-Python statement of the hierarchy
rules on small random inputs (nulls, empty codes, names without a code,
names with and without brackets). Net values are distinct so that the
order-dependent parts (group name, top-N) have one right answer."""

import random
from decimal import Decimal

from pyspark.sql import types as T

from test_clean import py_base_code, py_group_name, py_option_label
from tillroll.operators import drilldown as D


def py_supplier_matrix(rows, top=50, keep_null_category=False):
    leaves = {}
    for sup, cat, code, name, net, qty in rows:
        if sup is None or (cat is None and not keep_null_category):
            continue
        k = (sup, cat, code, name)
        a = leaves.setdefault(k, [Decimal(0), 0.0])
        a[0] += net
        a[1] += qty
    groups, cats, sups = {}, {}, {}
    for (sup, cat, code, name), (net, qty) in sorted(leaves.items(), key=lambda kv: -kv[1][0]):
        base = py_base_code(name) or code or "기타"
        g = groups.setdefault((sup, cat, base), {"total": Decimal(0), "qty": 0.0, "name": "",
                                                 "options": []})
        if not g["name"] and name:
            g["name"] = py_group_name(name)
        g["options"].append((code, name, py_option_label(name, base), net, qty))
        g["total"] += net
        g["qty"] += qty
        c = cats.setdefault((sup, cat), [Decimal(0), 0.0])
        c[0] += net
        c[1] += qty
        s = sups.setdefault(sup, [Decimal(0), 0.0])
        s[0] += net
        s[1] += qty
    out = set()
    by_cat = {}
    for (sup, cat, base), g in groups.items():
        by_cat.setdefault((sup, cat), []).append((base, g))
    for (sup, cat), gs in by_cat.items():
        gs.sort(key=lambda bg: (-bg[1]["total"], bg[0]))
        for rank, (base, g) in enumerate(gs[:top], start=1):
            for code, name, opt, net, qty in g["options"]:
                out.add((sup, float(sups[sup][0]), cat, float(cats[(sup, cat)][0]), base, g["name"],
                         float(g["total"]), len(g["options"]), rank, code, name, opt, float(net),
                         qty))
    return out


SCHEMA = T.StructType([T.StructField("supplier", T.StringType()),
                       T.StructField("category", T.StringType()),
                       T.StructField("product_code", T.StringType()),
                       T.StructField("product_name", T.StringType()),
                       T.StructField("net_sales", T.DecimalType(18, 4)),
                       T.StructField("sold_qty", T.DoubleType()),
                       T.StructField("file_id", T.IntegerType())])


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    names = ["BJK001_[블랙-L]조끼", "BJK001_[블랙-XL]조끼", "BT027_F001[BK-XL]", "ABC123 상품",
             "1234ABC 상품", "작업조끼", "A_조끼[L]", "X_", None, "", " pt01_바지 ", "Q9_[x]"]
    rows = []
    used = set()
    for _ in range(n):
        net = Decimal(rnd.randint(1, 10 ** 6)) / 100
        while net in used:
            net += Decimal("0.01")
        used.add(net)
        rows.append((rnd.choice(["s1", "s2", None]), rnd.choice(["c1", "c2", "", None]),
                     rnd.choice(["00001", "00002", "", None]), rnd.choice(names), net,
                     float(rnd.randint(1, 9)), 1))
    return rows


def test_supplier_matrix_matches_python(spark):
    for seed in range(3):
        rows = random_rows(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = D.supplier_category_matrix(df, top_groups=3).collect()
        flat = {(r.supplier, r.supplier_total, r.category, r.category_total, r.base_code,
                 r.group_name, r.group_total, r.option_count, r.group_rank, r.product_code,
                 r.product_name, r.option_name, r.net_sales, r.sold_qty) for r in got}
        want = py_supplier_matrix([r[:6] for r in rows], top=3)
        assert len(got) == len(flat)
        assert flat == want
        got_n = D.supplier_category_matrix(df, top_groups=3, keep_null_category=True).collect()
        flat_n = {(r.supplier, r.supplier_total, r.category, r.category_total, r.base_code,
                   r.group_name, r.group_total, r.option_count, r.group_rank, r.product_code,
                   r.product_name, r.option_name, r.net_sales, r.sold_qty) for r in got_n}
        assert len(got_n) == len(flat_n)
        assert flat_n == py_supplier_matrix([r[:6] for r in rows], top=3, keep_null_category=True)
        assert any(r.category is None for r in got_n)


def test_store_matrix_matches_python(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        rows.append((rnd.choice([f"st{k}" for k in range(8)] + [None]),
                     rnd.choice(["a(x)", "b", "", None]), f"{rnd.randint(1, 30):05d}", "n",
                     Decimal(i * 7 + 1) / 100, 1.0, 1))
    schema = T.StructType([T.StructField("store", T.StringType()),
                           T.StructField("classification", T.StringType()),
                           *SCHEMA.fields[2:]])
    got = D.store_category_matrix(spark.createDataFrame(rows, schema), top_stores=3,
                                  top_products=2).collect()
    leaves = {}
    for st, cls, code, name, net, qty, _ in rows:
        if st is None or cls is None:
            continue
        a = leaves.setdefault((st, cls, code, name), [Decimal(0), 0.0])
        a[0] += net
        a[1] += qty
    store_tot, cat_tot, prods = {}, {}, {}
    for (st, cls, code, name), (net, qty) in leaves.items():
        cat = cls or "기타"
        store_tot[st] = store_tot.get(st, 0) + net
        cat_tot[(st, cat)] = cat_tot.get((st, cat), 0) + net
        prods.setdefault((st, cat), []).append((net, code, name))
    best = sorted(store_tot, key=lambda s: (-store_tot[s], s))[:3]
    want = set()
    for (st, cat), ps in prods.items():
        if st not in best:
            continue
        for rank, (net, code, name) in enumerate(sorted(ps, key=lambda p: (-p[0], p[1], p[2]))[:2], 1):
            want.add((st, float(store_tot[st]), best.index(st) + 1, cat, float(cat_tot[(st, cat)]),
                      rank, code, float(net)))
    flat = {(r.store, r.store_total, r.store_rank, r.category, r.category_total, r.product_rank,
             r.product_code, r.net_sales) for r in got}
    assert flat == want and len(got) == len(want)


def test_store_tree_nests_the_flat_rows(spark):
    from tillroll.plans.fixtures import Fixtures
    from conftest import SF_SMALL
    fx = Fixtures(spark, SF_SMALL)
    flat = D.store_category_matrix(fx.store_sales, top_stores=4, top_products=3)
    tree = D.store_category_tree(flat).collect()
    assert [t.store_rank for t in tree] == [1, 2, 3, 4]
    n = sum(len(c.products) for t in tree for c in t.categories)
    assert n == flat.count()
    for t in tree:
        totals = [c.total for c in t.categories]
        assert totals == sorted(totals, reverse=True)
        for c in t.categories:
            assert [p["rank"] for p in c.products] == list(range(1, len(c.products) + 1))
            assert len(c.products) <= 3
