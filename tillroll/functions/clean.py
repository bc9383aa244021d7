"""Cleaning rules as native Column expressions (no UDFs).

Every function takes and returns ``Column`` objects so that the rules run
inside whole-stage codegen wherever they are used. Session ANSI mode is on
by default in Spark 4, so all parsing goes through ``try_*`` functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STORE_SUBTOTAL_MARK, SUMMARY_ROW_MARK, UNASSIGNED_SUPPLIER

# The characters Python's str.strip() removes by default (its
# white-space set: str.isspace() is true for exactly these code points).
# Spark's trim() removes only spaces, so the set is passed to btrim().
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Plain decimal / scientific notation; Spark would also accept "1d" or "1f".
NUMERIC_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# "category(supplier)": last "(" before the last ")" with nothing bracketed after
CLASSIFICATION_RE = r"(?s)^(.*)\(([^(]*)\)[^()]*$"

# Base product code patterns (fixed values).
CODE_WHOLE_RE = r"^[A-Za-z0-9]+$"
CODE_LETTERS_FIRST_RE = r"^([A-Za-z]+[0-9]+[A-Za-z0-9]*)"
CODE_DIGITS_FIRST_RE = r"^([0-9]+[A-Za-z]+[A-Za-z0-9]*)"

# Spreadsheet serial day 0 (1900 leap-year quirk included).
SERIAL_EPOCH = "1899-12-30"

# Text date layouts tried for "other" date strings.
DATE_LAYOUTS = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d.M.yyyy", "yyyy-M-d H:m",
                "yyyy-M-d H:m:s", "yyyy/M/d H:m", "yyyy/M/d H:m:s", "yyyy-M-d'T'H:m:s"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Python-style ``strip()``: drop leading/trailing Unicode white space
    (a character-set trim, no regular expression)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def blank(c) -> Column:
    """True for null or the empty string (Python's ``not value`` on text)."""
    c = _c(c)
    return c.isNull() | (c == "")


# --- C1 --------------------------------------------------------------------
def split_classification(c) -> tuple[Column, Column]:
    """``"category(supplier)"`` -> (category, supplier).

    Uses the last "(" and the last ")" when the "(" comes first; both parts
    are stripped. Otherwise the whole stripped text is the category and the
    supplier is the unassigned label. Null or empty input gives (null, null).
    """
    c = _c(c)
    s = ustrip(c)
    has = s.rlike(CLASSIFICATION_RE)
    cat = (F.when(blank(c), F.lit(None).cast("string"))
           .when(has, ustrip(F.regexp_extract(s, CLASSIFICATION_RE, 1)))
           .otherwise(s))
    sup = (F.when(blank(c), F.lit(None).cast("string"))
           .when(has, ustrip(F.regexp_extract(s, CLASSIFICATION_RE, 2)))
           .otherwise(F.lit(UNASSIGNED_SUPPLIER)))
    return cat, sup


def with_classification(df, src: str = "classification", cat: str = "category",
                        sup: str = "supplier"):
    """C1 as a DataFrame step: the stripped text and the pattern test are
    computed once (separate projections) and shared by both outputs."""
    c = F.col(src) if src in df.columns else F.lit(None).cast("string")
    staged = df.withColumn("_cls_s", ustrip(c)).withColumn(
        "_cls_m", F.col("_cls_s").rlike(CLASSIFICATION_RE))
    s, has = F.col("_cls_s"), F.col("_cls_m")
    none = F.lit(None).cast("string")
    return (staged
            .withColumn(cat, F.when(blank(c), none)
                        .when(has, ustrip(F.regexp_extract(s, CLASSIFICATION_RE, 1))).otherwise(s))
            .withColumn(sup, F.when(blank(c), none)
                        .when(has, ustrip(F.regexp_extract(s, CLASSIFICATION_RE, 2)))
                        .otherwise(F.lit(UNASSIGNED_SUPPLIER)))
            .drop("_cls_s", "_cls_m"))


# --- C2 / C12 ----------------------------------------------------------------
def number_text(c) -> Column:
    """The text of a number: commas and outer spaces removed. Other white
    space is left to ``_odd_ends``."""
    return F.trim(F.replace(_c(c).cast("string"), F.lit(","), F.lit("")))


def _odd_ends(t: Column) -> Column:
    """Whether a text begins or ends with a character that is no visible ASCII
    one, as white space other than a space does."""
    return ~F.ascii(t).between(33, 126) | ~F.ascii(F.substring(t, -1, 1)).between(33, 126)


def is_number_text(t: Column) -> Column:
    """Whether a prepared text (``number_text``) is a number. The whole white
    space set is trimmed only from texts with odd ends."""
    return F.when(t.rlike(NUMERIC_RE), F.lit(True)).when(_odd_ends(t), ustrip(t).rlike(NUMERIC_RE)).otherwise(F.lit(False))


def number_of(t: Column, kind) -> Column:
    """A prepared text as a number of type ``kind``; null for what is no
    number or does not fit."""
    return (F.when(t.rlike(NUMERIC_RE), t.try_cast(kind))
            .when(_odd_ends(t), F.when(ustrip(t).rlike(NUMERIC_RE), ustrip(t).try_cast(kind))))


def to_number(c) -> Column:
    """Text -> double: commas removed, stripped; unparsable -> null."""
    return number_of(number_text(c), "double")


def to_decimal(c, kind) -> Column:
    """Text -> exact decimal of type ``kind``: commas removed, stripped; null
    for what is no number or does not fit."""
    return number_of(number_text(c), kind)


def with_numbers(df, kinds: dict):
    """C2 for the columns ``kinds`` (name -> type) in place. Every text is
    prepared once, in a projection below the one that parses it."""
    texts = {n: f"_text_{n}" for n in kinds}
    return (df.withColumns({t: number_text(F.col(n)) for n, t in texts.items()})
            .withColumns({n: number_of(F.col(texts[n]), kind) for n, kind in kinds.items()}).drop(*texts.values()))


def number_or_zero(c) -> Column:
    """``safe_float``: C2 with 0.0 for anything unparsable."""
    return F.coalesce(to_number(c), F.lit(0.0))


def int_or_zero(c) -> Column:
    """``safe_int``: C2 truncated toward zero, 0 when unparsable."""
    return F.coalesce(to_number(c).try_cast("int"), F.lit(0))


# --- C3 / C4 ---------------------------------------------------------------
def base_product_code(name, stripped=None) -> Column:
    """Base code of a product name (upper-cased) or null.

    1. text before the first "_" when it is purely letters/digits;
    2. a leading letters+digits(+alnum) run;
    3. a leading digits+letters(+alnum) run.
    """
    name = _c(name)
    s = ustrip(name) if stripped is None else _c(stripped)
    head = ustrip(F.substring_index(s, "_", 1))
    p1 = F.when(s.contains("_") & head.rlike(CODE_WHOLE_RE), F.upper(head))
    p2 = F.nullif(F.regexp_extract(s, CODE_LETTERS_FIRST_RE, 1), F.lit(""))
    p3 = F.nullif(F.regexp_extract(s, CODE_DIGITS_FIRST_RE, 1), F.lit(""))
    return F.when(blank(name), F.lit(None).cast("string")).otherwise(
        F.coalesce(p1, F.upper(p2), F.upper(p3)))


def option_label(name, base_code, stripped=None) -> Column:
    """Display name without the base code (the option part of a name)."""
    name, base_code = _c(name), _c(base_code)
    s = ustrip(name) if stripped is None else _c(stripped)
    after_us = ustrip(F.regexp_extract(s, r"(?s)^[^_]*_(.*)$", 1))
    rest = ustrip(s.substr(F.length(base_code) + 1, F.length(s) + 1))
    return (F.when(blank(name) | blank(base_code), name)
            .when(s.contains("_"), after_us)
            .when(F.upper(s).startswith(base_code), F.when(rest != "", rest).otherwise(s))
            .otherwise(s))


# --- C5 ------------------------------------------------------------------------
# rough shape a text date must have before any layout is tried: parsing
# failures are costly, so plain words never reach the parsers
_DATE_SHAPE_RE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"


def _sale_date(s: Column, v: Column) -> Column:
    head10 = F.replace(F.substring(s, 1, 10), F.lit("/"), F.lit("-"))
    texty = (F.length(s) >= 10) & F.substring(s, 5, 1).isin("-", "/")
    eight = s.rlike(r"^\d{8}$")
    serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), v.try_cast("int"))
    unix = F.to_date(F.timestamp_seconds(v))
    other = F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(fmt))) for fmt in DATE_LAYOUTS])
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("date"))
            .when(texty, F.to_date(F.try_to_timestamp(head10, F.lit("yyyy-MM-dd"))))
            .when(eight, F.to_date(F.try_to_timestamp(s, F.lit("yyyyMMdd"))))
            .when((v > 1) & (v < 100000), serial)
            .when(v.isNotNull() & (F.abs(v) < 9.2e9), unix)
            .when(v.isNotNull() | ~s.rlike(_DATE_SHAPE_RE), F.lit(None).cast("date"))
            .otherwise(other))


def to_sale_date(c) -> Column:
    """Mixed date text -> DateType.

    * text of 10+ chars with "-" or "/" at position 5: its first 10 chars;
    * 8 digits: ``yyyyMMdd``;
    * a number 1 < v < 100000: spreadsheet serial day;
    * any other number: unix seconds (UTC), within pandas' timestamp range;
    * other text: the layouts in ``DATE_LAYOUTS``.
    Anything else, and impossible calendar dates, give null.
    """
    s = ustrip(_c(c).cast("string"))
    return _sale_date(s, to_number(s))


def with_sale_date(df, src: str, out: str = "sale_date"):
    """C5 as a DataFrame step: the stripped text and its number are computed
    once and shared by every rule."""
    staged = (df.withColumn("_dt_s", ustrip(F.col(src).cast("string")))
              .withColumn("_dt_v", to_number(F.col("_dt_s"))))
    return (staged.withColumn(out, _sale_date(F.col("_dt_s"), F.col("_dt_v")))
            .drop("_dt_s", "_dt_v"))


# --- C6 ------------------------------------------------------------------------
def group_display_name(name) -> Column:
    """Representative name of a product group.

    Last "_"-part of the name; if it holds "[" and "]", the text after "]"
    (stripped), or the text before "[" when "]" ends the part; an empty
    result falls back to the part itself. Names without "_" stay whole.
    """
    name = _c(name)
    last = F.substring_index(name, "_", -1)
    b_open = F.instr(last, "[")
    b_close = F.instr(last, "]")
    after = ustrip(last.substr(b_close + 1, F.length(last) + 1))
    before = ustrip(last.substr(F.lit(1), b_open - 1))
    picked = F.when(b_close < F.length(last), after).otherwise(before)
    bracketed = F.when(picked != "", picked).otherwise(last)
    return (F.when(name.isNull(), F.lit(None).cast("string"))
            .when(~name.contains("_"), name)
            .when((b_open > 0) & (b_close > 0), bracketed)
            .otherwise(last))


# --- C7 ------------------------------------------------------------------------
# Sheet-name keywords and the data_type label they give.
SHEET_TYPES = [("의류", "clothing", "의류"), ("신발", "shoes", "신발"), ("잡화", "accessories", "잡화")]


def sheet_data_type(sheet) -> Column:
    """Sheet name -> data_type label (the sheet name itself when unmatched)."""
    sheet = _c(sheet)
    out = None
    for kor, eng, label in SHEET_TYPES:
        cond = sheet.contains(kor) | F.lower(sheet).contains(eng)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(sheet)


# --- C8 / C9 / C15 -------------------------------------------------------------
def keep_sales_line(product_name) -> Column:
    """Drop empty, null ("nan") and summary ("row(s)") product names."""
    n = _c(product_name)
    return F.coalesce(~((n == "") | (n == "nan") | n.contains(SUMMARY_ROW_MARK)), F.lit(False))


def keep_store_line(store) -> Column:
    """Drop store sub-total rows; a null store is kept."""
    return ~F.coalesce(_c(store).contains(STORE_SUBTOTAL_MARK), F.lit(False))


# --- C10 / C11 / C13 / C14 ------------------------------------------------------
def padded_code(c) -> Column:
    """Numeric product code -> integer text zero-padded to 5; others stripped.

    Blank or null codes give "". (The source loader aborts on a non-numeric
    code; here the stripped text is kept instead.)
    """
    s = ustrip(_c(c).cast("string"))
    v = to_number(s)
    as_int = F.when(F.abs(v) < 9.2e18, v.try_cast("long").cast("string"))
    padded = F.when(F.length(as_int) < 5, F.lpad(as_int, 5, "0")).otherwise(as_int)
    return (F.when(s.isNull() | (s == "") | (s == "nan"), F.lit(""))
            .when(as_int.isNotNull(), padded)
            .otherwise(s))


def image_url(base_url: str, code) -> Column:
    """Catalog image address from a product code."""
    return F.concat(F.lit(base_url), _c(code), F.lit("_500.png"))


# Text the stock file uses for "sold out".
SOLDOUT_TRUE = ["Y", "y", "1", "true", "True"]


def soldout_flag(c) -> Column:
    """1 when the stripped text is one of ``SOLDOUT_TRUE``, else 0."""
    return F.coalesce(ustrip(_c(c).cast("string")).isin(SOLDOUT_TRUE), F.lit(False)).cast("int")


def clip(c, width: int, trim_first: bool = False) -> Column:
    """Clip text to ``width`` characters and strip (or strip, then clip)."""
    c = _c(c).cast("string")
    if trim_first:
        return F.substring(ustrip(c), 1, width)
    return ustrip(F.substring(c, 1, width))


# --- C16 -----------------------------------------------------------------------
# Stock status labels.
STOCK_NORMAL, STOCK_LOW, STOCK_OUT = "정상", "부족", "품절"


def stock_status(stock) -> Column:
    """More than 10 -> normal, more than 0 -> low, else sold out (null = 0)."""
    s = F.coalesce(_c(stock), F.lit(0))
    return (F.when(s > 10, F.lit(STOCK_NORMAL)).when(s > 0, F.lit(STOCK_LOW))
            .otherwise(F.lit(STOCK_OUT)))


# --- C17 / C18 / C19 ------------------------------------------------------------
def monday_week_number(d) -> Column:
    """``strftime('%W')``: weeks start Monday; days before the first Monday are 0."""
    d = _c(d)
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def week_label(d, mode: str = "monday") -> Column:
    """``YYYY-Www`` with the calendar year.

    ``monday``: ``%W`` + 1 (the SQL form); ``iso``: ISO week number, still with
    the calendar year, so 29-31 Dec may be labelled W01 of the old year.
    """
    d = _c(d)
    wk = monday_week_number(d) + 1 if mode == "monday" else F.weekofyear(d)
    return F.format_string("%04d-W%02d", F.year(d), wk)


def week_number(d, mode: str = "monday") -> Column:
    """The week of ``week_label`` as one integer: year * 100 + week."""
    d = _c(d)
    wk = monday_week_number(d) + 1 if mode == "monday" else F.weekofyear(d)
    return F.year(d) * 100 + wk


def month_key(d) -> Column:
    """``YYYY-MM`` of a date."""
    return F.date_format(_c(d), "yyyy-MM")


# --- C21 -------------------------------------------------------------------------
# Catalog tab keywords (matched on the lower-cased product
# name) and code prefixes (matched on the lower-cased product code).
TAG_TOP = "상의"
TAG_BOTTOM = "하의"
TAG_ACCESSORY = "잡화"
TAG_OTHER = "기타"
TOP_WORDS = ["티셔츠", "셔츠", "자켓", "점퍼", "조끼", "상의"]
TOP_CODE_PREFIXES = ["bjk", "jk"]
BOTTOM_WORDS = ["바지", "팬츠", "하의"]
BOTTOM_CODE_PREFIXES = ["pt", "pant"]
ACCESSORY_WORDS = ["모자", "장갑", "벨트", "가방", "양말", "신발", "안전화", "부츠"]


def _any(col: Column, items, how: str) -> Column:
    conds = [(col.contains(w) if how == "contains" else col.startswith(w)) for w in items]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def catalog_tags(name, code, other: str = "all") -> Column:
    """Array of catalog tabs a product belongs to (tabs overlap).

    ``other='all'``: the "other" tab matches every product (what the page
    does); ``'strict'``: only products without any other tab.
    """
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    k = F.lower(F.coalesce(_c(code), F.lit("")))
    top = _any(n, TOP_WORDS, "contains") | _any(k, TOP_CODE_PREFIXES, "startswith")
    bottom = _any(n, BOTTOM_WORDS, "contains") | _any(k, BOTTOM_CODE_PREFIXES, "startswith")
    acc = _any(n, ACCESSORY_WORDS, "contains")
    other_c = F.lit(True) if other == "all" else ~(top | bottom | acc)
    return F.array_compact(F.array(
        F.when(top, F.lit(TAG_TOP)), F.when(bottom, F.lit(TAG_BOTTOM)),
        F.when(acc, F.lit(TAG_ACCESSORY)), F.when(other_c, F.lit(TAG_OTHER))))
