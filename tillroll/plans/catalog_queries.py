"""Registered catalog and stock queries (A11, A12, A15, F5-F14, J1-J3, C16,
C21, O2) with their DuckDB oracles."""

from __future__ import annotations

from ..functions import clean as C
from ..operators import catalog as K, inventory as I
from ..sources import keyed as KT
from .registry import REGISTRY, query

_GROUPS = """
SELECT product_code, min(product_name) AS product_name,
       string_agg(DISTINCT supplier_option, ',' ORDER BY supplier_option) AS supplier_option,
       min(image_url) AS image_url, count(*) AS option_count
FROM product_images {where} GROUP BY product_code
ORDER BY min(product_name) NULLS FIRST, product_code NULLS FIRST {limit}"""


@query("catalog_groups", views=("product_images",), sql=_GROUPS.format(where="", limit=""))
def _a11(fx):
    """Catalog grouped by product code."""
    return K.catalog_groups(fx.product_images)


@query("catalog_count", views=("product_images",),
       sql="SELECT count(*) AS row_count FROM product_images")
def _a15(fx):
    """Catalog row count."""
    return K.catalog_count(fx.product_images)


@query("catalog_search", views=("product_images",), sql=_GROUPS.format(
    where="WHERE contains(lower(product_name), 'red')", limit="LIMIT 100"))
def _f5(fx):
    """catalog groups whose names contain 'red', first 100 by name."""
    return K.search_catalog(fx.product_images, "red")


@query("image_by_option", views=("product_images",), sql="""
SELECT * FROM product_images WHERE supplier_option = 'SO0007 SMALL'
ORDER BY product_code NULLS FIRST, product_name NULLS FIRST, barcode NULLS FIRST,
         image_url NULLS FIRST LIMIT 1""")
def _f8(fx):
    """F8: image row of one supplier option."""
    return K.image_by_option(fx.product_images, "SO0007 SMALL")


@query("image_by_code", views=("product_images",), sql="""
SELECT * FROM product_images WHERE product_code = '00007'
ORDER BY supplier_option NULLS FIRST, product_name NULLS FIRST, barcode NULLS FIRST,
         image_url NULLS FIRST LIMIT 1""")
def _f9(fx):
    """image row of one product code."""
    return K.image_by_code(fx.product_images, "00007")


def _tags_sql(other_all: bool = True) -> str:
    n, k = "lower(coalesce(product_name, ''))", "lower(coalesce(product_code, ''))"
    top = " OR ".join([f"contains({n}, '{w}')" for w in C.TOP_WORDS]
                      + [f"starts_with({k}, '{p}')" for p in C.TOP_CODE_PREFIXES])
    bottom = " OR ".join([f"contains({n}, '{w}')" for w in C.BOTTOM_WORDS]
                         + [f"starts_with({k}, '{p}')" for p in C.BOTTOM_CODE_PREFIXES])
    acc = " OR ".join(f"contains({n}, '{w}')" for w in C.ACCESSORY_WORDS)
    other = "true" if other_all else f"NOT (({top}) OR ({bottom}) OR ({acc}))"
    return (f"list_filter([CASE WHEN {top} THEN '{C.TAG_TOP}' END, "
            f"CASE WHEN {bottom} THEN '{C.TAG_BOTTOM}' END, "
            f"CASE WHEN {acc} THEN '{C.TAG_ACCESSORY}' END, "
            f"CASE WHEN {other} THEN '{C.TAG_OTHER}' END], lambda x: x IS NOT NULL)")


_GROUPED = "(" + _GROUPS.format(where="", limit="") + ")"


@query("catalog_tagged", views=("product_images",), sql=f"""
SELECT *, {_tags_sql(False)} AS tags FROM {_GROUPED} g""")
def _c21(fx):
    """Grouped catalog with its tab tags ('other' = none of the rest)."""
    return K.with_tags(K.catalog_groups(fx.product_images), other="strict")


@query("catalog_tab_other", views=("product_images",), sql=f"""
SELECT * FROM {_GROUPED} g WHERE list_contains({_tags_sql(False)}, '{C.TAG_OTHER}')""")
def _f12(fx):
    """grouped catalog rows in the 'other' tab, strict form (rows in
    none of the top / bottom / accessory tabs)."""
    return K.catalog_tab(K.catalog_groups(fx.product_images), C.TAG_OTHER, other="strict")


@query("catalog_find", views=("product_images",), sql=f"""
SELECT * FROM {_GROUPED} g
WHERE contains(lower(product_name), 'bjk01') OR contains(lower(product_code), 'bjk01')""")
def _f11(fx):
    """grouped catalog rows whose name or code contains ' BJK01 '."""
    return K.catalog_find(K.catalog_groups(fx.product_images), " BJK01 ")


@query("product_options_with_stock", views=("product_images", "inventory"), sql="""
SELECT p.product_code, p.supplier_option, p.product_name, p.barcode,
       coalesce(s.normal_stock, 0) AS normal_stock, coalesce(s.available_stock, 0) AS available_stock
FROM product_images p LEFT JOIN (
  SELECT supplier_option, max({'n': normal_stock, 'a': available_stock}) AS st
  FROM inventory GROUP BY supplier_option) t ON p.supplier_option = t.supplier_option
LEFT JOIN LATERAL (SELECT t.st.n AS normal_stock, t.st.a AS available_stock) s ON true
ORDER BY p.product_code, p.supplier_option""")
def _j2(fx):
    """Every catalog option with one stock row (missing stock -> 0)."""
    return K.product_options_with_stock(fx.product_images, fx.inventory, one_per_option=True)


@query("product_options_fanout", views=("product_images", "inventory"), sql="""
SELECT p.product_code, p.supplier_option, p.product_name, p.barcode,
       coalesce(i.normal_stock, 0) AS normal_stock, coalesce(i.available_stock, 0) AS available_stock
FROM product_images p LEFT JOIN inventory i ON p.supplier_option = i.supplier_option
WHERE p.product_code = '00007' ORDER BY p.supplier_option""")
def _j1(fx):
    """One product's options LEFT JOIN every matching stock row."""
    return K.product_options_with_stock(fx.product_images, fx.inventory, product_code="00007")


@query("option_rollup", views=("product_images", "inventory"), sql="""
SELECT product_code, count(*) AS option_count, cast(sum(ns) AS bigint) AS total_stock,
       count(CASE WHEN ns = 0 THEN 1 END) AS soldout_options
FROM (SELECT p.product_code, coalesce(t.st.n, 0) AS ns
      FROM product_images p LEFT JOIN (
        SELECT supplier_option, max({'n': normal_stock, 'a': available_stock}) AS st
        FROM inventory GROUP BY supplier_option) t ON p.supplier_option = t.supplier_option)
GROUP BY product_code""")
def _j3(fx):
    """Per product: options, total stock and sold-out options."""
    return K.option_rollup(K.product_options_with_stock(fx.product_images, fx.inventory, one_per_option=True))


@query("inventory_summary", views=("inventory",), sql="""
SELECT count(*) AS total_products, count(CASE WHEN normal_stock > 0 THEN 1 END) AS in_stock,
       count(CASE WHEN normal_stock = 0 THEN 1 END) AS out_of_stock,
       cast(sum(normal_stock) AS bigint) AS total_normal_stock,
       cast(sum(available_stock) AS bigint) AS total_available_stock
FROM inventory""")
def _a12(fx):
    """Stock summary."""
    return I.inventory_summary(fx.inventory)


_ORDER = ("normal_stock DESC NULLS LAST, product_code NULLS FIRST, supplier_option NULLS FIRST, "
          "product_name NULLS FIRST")


@query("all_inventory", views=("inventory",), sql=f"""
SELECT *, CASE WHEN coalesce(normal_stock, 0) > 10 THEN '{C.STOCK_NORMAL}'
               WHEN coalesce(normal_stock, 0) > 0 THEN '{C.STOCK_LOW}' ELSE '{C.STOCK_OUT}' END
          AS stock_status
FROM inventory ORDER BY {_ORDER}""")
def _o2(fx):
    """O2 + C16: full stock list by stock with its status label."""
    return I.with_stock_status(I.all_inventory(fx.inventory))


@query("inventory_first_page", views=("inventory",), sql=f"""
SELECT * FROM inventory ORDER BY {_ORDER} LIMIT 1000""")
def _o2l(fx):
    """O2 with the first-load limit of 1000 rows."""
    return I.all_inventory(fx.inventory, limit=1000)


@query("search_inventory", views=("inventory",), sql=f"""
SELECT * FROM inventory WHERE contains(lower(product_name), 'red') ORDER BY {_ORDER} LIMIT 100""")
def _f6(fx):
    """stock rows whose name contains 'red', 100 by stock."""
    return I.search_inventory(fx.inventory, "red")


@query("low_stock", views=("inventory",), sql="""
SELECT * FROM inventory WHERE normal_stock > 0 AND normal_stock <= 10
ORDER BY normal_stock, product_code NULLS FIRST, supplier_option NULLS FIRST,
         product_name NULLS FIRST""")
def _f7(fx):
    """low stock (0 < stock <= 10)."""
    return I.low_stock(fx.inventory, 10)


@query("inventory_by_option", views=("inventory",), sql="""
SELECT * FROM inventory WHERE supplier_option = 'SO0007 SMALL'
ORDER BY product_code NULLS FIRST, product_name NULLS FIRST, normal_stock DESC NULLS LAST
LIMIT 1""")
def _f10(fx):
    """stock row of one supplier option."""
    return I.inventory_by_option(fx.inventory, "SO0007 SMALL")


@query("inventory_scan", views=("inventory",), sql="""
SELECT product_code, supplier_option, normal_stock FROM inventory
WHERE normal_stock >= 5 ORDER BY normal_stock DESC NULLS LAST, product_code NULLS FIRST,
  supplier_option NULLS FIRST LIMIT 200""")
def _s4(fx):
    """Scan with projection, filter, order and limit."""
    from ..sources.store import scan
    return scan(fx.inventory, ["product_code", "supplier_option", "normal_stock"],
                where="normal_stock >= 5",
                order_by=["-normal_stock", "product_code", "supplier_option"], limit=200)


@query("inventory_summary_not_in_stock", views=("inventory",), sql="""
SELECT count(*) AS total_products, count(CASE WHEN normal_stock > 0 THEN 1 END) AS in_stock,
       count(CASE WHEN NOT coalesce(normal_stock > 0, false) THEN 1 END) AS out_of_stock,
       cast(sum(normal_stock) AS bigint) AS total_normal_stock,
       cast(sum(available_stock) AS bigint) AS total_available_stock
FROM inventory""")
def _a12b(fx):
    """A12, counting every row not in stock as out of stock."""
    return I.inventory_summary(fx.inventory, out_of_stock="not_in_stock")


@query("catalog_listing", views=("product_images",), sql="""
SELECT product_code, rs[1].product_name AS product_name,
       list_reduce(rs[2:], lambda acc, x: CASE
           WHEN x.supplier_option IS NULL OR x.supplier_option = ''
             OR contains(coalesce(acc, ''), x.supplier_option) THEN acc
           ELSE concat_ws(', ', acc, x.supplier_option) END,
         rs[1].supplier_option) AS supplier_option,
       rs[1].image_url AS image_url, n AS option_count
FROM (SELECT product_code,
             list_sort(list({'product_name': product_name, 'supplier_option': supplier_option,
                             'image_url': image_url})) AS rs,
             count(*) AS n
      FROM product_images GROUP BY product_code)""")
def _a11l(fx):
    """A11 in the listing form (name order, substring-checked options)."""
    return K.catalog_listing(fx.product_images)


@query("stock_list_low", views=("inventory",), sql="""
SELECT * FROM inventory WHERE normal_stock > 0 AND normal_stock <= 10""")
def _f13(fx):
    """the stock list dispatcher without a keyword, asked for low stock."""
    return I.inventory_list(fx.inventory, low=True)


@query("image_lookup_code", views=("product_images",), sql="""
SELECT * FROM product_images WHERE product_code = '00007'
ORDER BY supplier_option NULLS FIRST, product_name NULLS FIRST, barcode NULLS FIRST, image_url NULLS FIRST LIMIT 1""")
def _f14(fx):
    """single image, no option given, so by code."""
    return K.image_lookup(fx.product_images, product_code="00007")


@query("image_list_search", views=("product_images",), sql=_GROUPS.format(
    where="WHERE contains(lower(product_name), 'red')", limit="LIMIT 100"))
def _f14l(fx):
    """the image list dispatcher with a keyword."""
    return K.catalog_list(fx.product_images, "red")


def _keyed(fx):
    """The catalog and the stock list as keyed copies."""
    tables = KT.KeyedTables(fx.spark, buckets=8)
    KT.save_catalog(tables, fx.product_images)
    tables.save("inventory_by_option", fx.inventory)
    return tables


@query("image_by_code_keyed", views=("product_images",), sql=REGISTRY["image_by_code"].sql)
def _f9k(fx):
    """F9 on the copy keyed by code: one bucket is read."""
    return K.image_by_code(_keyed(fx).open("catalog_by_code"), "00007")


@query("image_by_option_keyed", views=("product_images",), sql=REGISTRY["image_by_option"].sql)
def _f8k(fx):
    """F8 on the copy keyed by option: one bucket is read."""
    return K.image_by_option(_keyed(fx).open("catalog_by_option"), "SO0007 SMALL")


@query("product_options_keyed", views=("product_images", "inventory"), sql=REGISTRY["product_options_with_stock"].sql)
def _j2k(fx):
    """J2 on the copies keyed by option: grouped and joined without a shuffle
    of either side."""
    tables = _keyed(fx)
    return K.product_options_with_stock(tables.open("catalog_by_option"), tables.open("inventory_by_option"), one_per_option=True)


@query("product_options_fanout_keyed", views=("product_images", "inventory"), sql=REGISTRY["product_options_fanout"].sql)
def _j1k(fx):
    """J1 on the keyed copies."""
    return KT.options_of_product(_keyed(fx), "00007")
