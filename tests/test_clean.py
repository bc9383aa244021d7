"""Golden rows (FIXTURES.md section 2) and brute-force checks of the
cleaning rules against a plain-Python statement of each rule."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillroll.functions import clean as C


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_classification_golden(spark):
    vals = ["상의(업체)", "상의", None, "a(b)c(d", "a(b)c)", "  ", "", "x ( y ) "]
    cat, sup = C.split_classification("v")
    got = [(r.c, r.s) for r in one_col(spark, vals).select(cat.alias("c"), sup.alias("s")).collect()]
    assert got == [("상의", "업체"), ("상의", "미지정"), (None, None), ("a(b)c(d", "미지정"),
                   ("a", "b)c"), ("", "미지정"), (None, None), ("x", "y")]
    staged = C.with_classification(one_col(spark, vals).withColumnRenamed("v", "classification"))
    assert [(r.category, r.supplier) for r in staged.collect()] == got


def test_numbers_golden(spark):
    vals = ["1,234", " 12 ", "abc", None, "1d", "1e3", ".5", "-3.", "1_000", "nan"]
    got = [r.n for r in one_col(spark, vals).select(C.to_number("v").alias("n")).collect()]
    assert got == [1234.0, 12.0, None, None, None, 1000.0, 0.5, -3.0, None, None]
    z = [r.n for r in one_col(spark, ["3.9", "x", None, "-2.5"]).select(
        C.int_or_zero("v").alias("n")).collect()]
    assert z == [3, 0, 0, -2]


def test_base_code_option_group_golden(spark):
    names = ["BJK001_[블랙-L]작업조끼", "BT027_F001[BK-XL]", "ABC123 일반상품", "1234ABC 상품",
             "작업조끼", "A_조끼[L]", None, "BJK031_블랙 L 멀티베스트"]
    df = one_col(spark, names)
    b = C.base_product_code("v")
    rows = df.select(b.alias("b"), C.option_label("v", b).alias("o"),
                     C.group_display_name("v").alias("g")).collect()
    assert [r.b for r in rows] == ["BJK001", "BT027", "ABC123", "1234ABC", None, "A", None, "BJK031"]
    assert rows[0].o == "[블랙-L]작업조끼" and rows[7].o == "블랙 L 멀티베스트"
    assert rows[0].g == "작업조끼" and rows[5].g == "조끼" and rows[1].g == "F001"


def test_dates_golden(spark):
    vals = ["2024/01/05 10:00", "45292", None, "20240105", "unknown", "2024-02-30",
            "1700000000", "3/4/2024", "  2023-12-31  "]
    got = [None if r.d is None else r.d.isoformat()
           for r in one_col(spark, vals).select(C.to_sale_date("v").alias("d")).collect()]
    assert got == ["2024-01-05", "2024-01-01", None, "2024-01-05", None, None, "2023-11-14",
                   "2024-03-04", "2023-12-31"]
    staged = C.with_sale_date(one_col(spark, vals), "v", "d")
    assert [None if r.d is None else r.d.isoformat() for r in staged.collect()] == got


def test_misc_golden(spark):
    pad = [r.p for r in one_col(spark, ["881", "123456", "12.0", "", None, "AB1"]).select(
        C.padded_code("v").alias("p")).collect()]
    assert pad == ["00881", "123456", "00012", "", "", "AB1"]
    status = [r.s for r in one_col(spark, [11, 10, 0, None], "int").select(
        C.stock_status("v").alias("s")).collect()]
    assert status == [C.STOCK_NORMAL, C.STOCK_LOW, C.STOCK_OUT, C.STOCK_OUT]
    sold = [r.s for r in one_col(spark, ["Y", " y ", "1", "true", "True", "N", None, "TRUE"]).select(
        C.soldout_flag("v").alias("s")).collect()]
    assert sold == [1, 1, 1, 1, 1, 0, 0, 0]
    sheets = [r.t for r in one_col(spark, ["의류 1월", "Shoes", "잡화", "기타시트"]).select(
        C.sheet_data_type("v").alias("t")).collect()]
    assert sheets == ["의류", "신발", "잡화", "기타시트"]
    keep = [r.k for r in one_col(spark, ["a", "", None, "nan", "3 row(s)", " "]).select(
        C.keep_sales_line("v").alias("k")).collect()]
    assert keep == [True, False, False, False, False, True]
    keep_store = [r.k for r in one_col(spark, ["s1", "매장수 3", None]).select(
        C.keep_store_line("v").alias("k")).collect()]
    assert keep_store == [True, False, True]


def test_week_labels(spark):
    import datetime as dt
    days = [dt.date(2024, 1, 1), dt.date(2023, 1, 1), dt.date(2022, 12, 31), dt.date(2021, 1, 3),
            dt.date(2020, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(C.week_label("d").alias("w"), C.week_label("d", "iso").alias("i")).collect()
    want_w = [f"{d.year:04d}-W{int(d.strftime('%W')) + 1:02d}" for d in days]
    want_i = [f"{d.year:04d}-W{d.isocalendar()[1]:02d}" for d in days]
    assert [r.w for r in got] == want_w
    assert [r.i for r in got] == want_i


def test_catalog_tags(spark):
    df = spark.createDataFrame([("검정 티셔츠", "00001"), ("작업 바지", "PT01"), ("가죽 장갑", "x"),
                                ("뭔가", "bjk9"), ("그냥", "1")], "n string, c string")
    got = [r.t for r in df.select(C.catalog_tags("n", "c").alias("t")).collect()]
    assert got == [["상의", "기타"], ["하의", "기타"], ["잡화", "기타"], ["상의", "기타"], ["기타"]]
    strict = [r.t for r in df.select(C.catalog_tags("n", "c", "strict").alias("t")).collect()]
    assert strict == [["상의"], ["하의"], ["잡화"], ["상의"], ["기타"]]


# --- brute force: the rules restated in plain Python --------------------------------
def py_classification(v):
    if v is None or v == "":
        return None, None
    s = v.strip()
    if "(" in s and ")" in s:
        lo, lc = s.rfind("("), s.rfind(")")
        if lo < lc:
            return s[:lo].strip(), s[lo + 1:lc].strip()
    return s, "미지정"


def py_base_code(v):
    if not v:
        return None
    s = v.strip()
    if "_" in s:
        head = s.split("_")[0].strip()
        if re.match(r"^[A-Za-z0-9]+\Z", head):
            return head.upper()
    m = re.match(r"^([A-Za-z]+[0-9]+[A-Za-z0-9]*)", s)
    if m:
        return m.group(1).upper()
    m = re.match(r"^([0-9]+[A-Za-z]+[A-Za-z0-9]*)", s)
    return m.group(1).upper() if m else None


def py_group_name(v):
    if v is None:
        return None
    if "_" not in v:
        return v
    last = v.split("_")[-1]
    if "[" in last and "]" in last:
        bs, be = last.find("["), last.find("]")
        base = last[be + 1:].strip() if be < len(last) - 1 else last[:bs].strip()
        return base if base else last
    return last


def py_option_label(name, base):
    if not name or not base:
        return name
    s = name.strip()
    if "_" in s:
        return s.split("_", 1)[1].strip()
    if s.upper().startswith(base):
        rest = s[len(base):].strip()
        return rest if rest else s
    return s


ALPHABET = st.sampled_from(list("aZ09_()[] -가\t") + ["　", "\xa0"])
TEXT = st.one_of(st.none(), st.text(ALPHABET, max_size=12))


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=60))
def test_rules_match_python(spark, values):
    df = one_col(spark, values)
    cat, sup = C.split_classification("v")
    b = C.base_product_code("v")
    rows = df.select("v", cat.alias("c"), sup.alias("s"), b.alias("b"),
                     C.group_display_name("v").alias("g"), C.option_label("v", b).alias("o")).collect()
    for r in rows:
        assert (r.c, r.s) == py_classification(r.v), r.v
        assert r.b == py_base_code(r.v), r.v
        assert r.g == py_group_name(r.v), r.v
        assert r.o == py_option_label(r.v, r.b), r.v


def test_strip_matches_python(spark):
    samples = ["　a b\xa0", "\x1c x \x1f", "\t\n y \r", "none", "", " z "]
    got = [r.s for r in one_col(spark, samples).select(C.ustrip("v").alias("s")).collect()]
    assert got == [s.strip() for s in samples]


@pytest.mark.parametrize("text,expected", [("1,234", 1234.0), ("+.5e1", 5.0), ("1 2", None)])
def test_to_number_cases(spark, text, expected):
    assert one_col(spark, [text]).select(C.to_number("v").alias("n")).first().n == expected
