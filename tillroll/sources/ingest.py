"""Reading and cleaning loaded files.

Raw files are read without a schema, so every column arrives as text under
its header name; cleaning then turns text into typed columns with native
expressions (``functions.clean``). Writes go through Spark to a
``TableStore``; inserted counts are taken with ``observe`` during the write
instead of a second pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as C
from ..schemas import (INVENTORY_SCHEMA, PRODUCT_IMAGES_SCHEMA, SALES_HEADERS, SALES_SCHEMA,  # noqa: F401
                       STORE_HEADERS, STORE_SALES_SCHEMA)
from .delimited import Records, read_records
from .row_ids import with_row_ids
from .store import TableStore


# --- S1 / S2 ---------------------------------------------------------------------------
def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8",
                   header: bool = True) -> DataFrame:
    """Delimited text with a header; all columns as text, by header name.

    Cells may be quoted, with doubled quotes and line breaks. Records that do
    not fit the header are left out; ``read_records`` gives them too.
    """
    return read_records(spark, path, sep, encoding, header).accepted()


def read_tsv_or_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """S1 for ``.xls`` exports that are really tab-separated text."""
    return read_delimited(spark, path, sep=separator(path), encoding=encoding)


def separator(path: str) -> str:
    return "\t" if path.lower().endswith((".xls", ".tsv", ".txt")) else ","


def read_sheets(spark: SparkSession, sheets: dict[str, str], sep: str = ",",
                encoding: str = "utf-8") -> DataFrame:
    """One delimited file per sheet -> one frame with a ``data_type``
    column derived from the sheet name (C7). Files with different headers are
    read separately and aligned by name."""
    return _sheets(sheets, lambda path: read_delimited(spark, path, sep, encoding))


def _sheets(sheets: dict[str, str], read: Callable[[str], DataFrame]) -> DataFrame:
    out = None
    for sheet, path in sheets.items():
        df = read(path).withColumn("data_type", C.sheet_data_type(F.lit(sheet)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# --- header handling -----------------------------------------------------------------------
def rename_headers(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename known input headers (surrounding blanks ignored) to internal names."""
    cols = []
    for c in df.columns:
        key = c.strip()
        cols.append(F.col(f"`{c}`").alias(mapping.get(key, key)))
    return df.select(*cols)


def conform(df: DataFrame, schema: T.StructType, carry: tuple[str, ...] = ()) -> DataFrame:
    """Select ``schema``'s columns, adding absent ones as typed nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType)
                       .alias(f.name) for f in schema.fields], *carry)


@dataclass(frozen=True)
class HeaderRule:
    """How the headers of one target column read: any of ``words`` in them,
    none of ``without``; ``starts`` / ``equals`` narrow the place. The first
    fitting header keeps the target when ``first`` is set, else the last."""
    target: str
    words: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    starts: str = ""
    equals: str | None = None
    first: bool = False

    def fits(self, header: str) -> bool:
        return ((self.equals is None or header == self.equals) and header.startswith(self.starts)
                and (not self.words or any(w in header for w in self.words))
                and not any(w in header for w in self.without))


# The words that the catalog and stock headers carry, in order
# of precedence.
CATALOG_RULES = [
    HeaderRule("product_code", ("상품코드",), without=("대표",), first=True),
    HeaderRule("product_name", ("상품명",), without=("공급처",), first=True),
    HeaderRule("supplier_option", ("공급처 옵션", "공급처옵션")),
    HeaderRule("barcode", ("바코드",)),
]
STOCK_RULES = [
    HeaderRule("product_code", ("상품코드",), first=True),
    HeaderRule("supplier", equals="공급처"),
    HeaderRule("supplier", starts="공급처", without=("옵션", "상품"), first=True),
    HeaderRule("product_name", ("상품명",), without=("공급처",), first=True),
    HeaderRule("option_name", ("옵션명",)),
    HeaderRule("option_name", equals="옵션"),
    HeaderRule("supply_price", ("공급가",)),
    HeaderRule("sale_price", ("판매가",)),
    HeaderRule("supplier_option", ("공급처옵션코드", "업체옵션코드", "공급처 옵션")),
    HeaderRule("barcode", ("바코드",)),
    HeaderRule("normal_stock", ("정상재고",)),
    HeaderRule("available_stock", ("가용재고",)),
    HeaderRule("is_soldout", ("품절여부",)),
]


def resolve_headers(columns: list[str], rules: list[HeaderRule]) -> dict[str, str]:
    """Target -> input header. A header serves one target: the
    foremost rule that it fits and that may still take it."""
    out: dict[str, str] = {}
    for col in columns:
        open_rules = (r for r in rules if r.fits(str(col).strip()) and not (r.first and r.target in out))
        rule = next(open_rules, None)
        if rule:
            out[rule.target] = col
    return out


def select_mapped(df: DataFrame, mapping: dict[str, str], targets: list[str]) -> DataFrame:
    """Pick the mapped headers as targets; an unmapped target is empty text."""
    return df.select(*[(F.col(f"`{mapping[t]}`") if t in mapping else F.lit(""))
                       .cast("string").alias(t) for t in targets])


# --- S7 / S8: sales lines ---------------------------------------------------------------------
def _with_measures(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """``df`` with the measures of ``schema`` that it has as numbers, and
    their names."""
    kinds = {f.name: f.dataType for f in schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.DecimalType)) and f.name in df.columns}
    return C.with_numbers(df, kinds), list(kinds)


def rejected_numbers(raw: DataFrame, headers: dict[str, str], schema: T.StructType) -> DataFrame:
    """Per measure column, how many non-empty values are no number, or no
    number that its type holds, and so load as null: (column_name, rejected)."""
    df = rename_headers(raw, headers)
    kinds = {f.name: f.dataType for f in schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.DecimalType)) and f.name in df.columns}
    lost = [F.count(F.when((C.ustrip(F.col(n).cast("string")) != "")
                           & (C.to_decimal(F.col(n), k) if isinstance(k, T.DecimalType)
                              else C.to_number(F.col(n))).isNull(), F.lit(1))).alias(n) for n, k in kinds.items()]
    if not lost:
        return df.sparkSession.createDataFrame([], "column_name string, rejected long")
    one = df.agg(*lost)
    return one.select(F.explode(F.create_map(*[x for n in kinds for x in (F.lit(n), F.col(n))]))
                      .alias("column_name", "rejected"))


def _file_id(file_id) -> Column:
    return (file_id if isinstance(file_id, Column) else F.lit(file_id)).cast("int")


def clean_sales(raw: DataFrame, file_id, carry: tuple[str, ...] = ()) -> DataFrame:
    """S7 cleaning: Korean headers -> typed sales lines of one file.

    Drops empty / summary product names (C8), splits the classification
    (C1), parses every measure (C2). Absent columns become nulls.
    ``file_id`` is a number or a column; ``carry`` columns pass through.
    """
    df = rename_headers(raw, SALES_HEADERS)
    name = F.col("product_name") if "product_name" in df.columns else F.lit(None).cast("string")
    df = C.with_classification(df.filter(C.keep_sales_line(name)))
    keep = [c for c in ("classification", "product_code", "barcode", "product_name") if c in df.columns]
    df, measures = _with_measures(df, SALES_SCHEMA)
    out = df.select(_file_id(file_id).alias("file_id"), *keep, "category", "supplier", *measures, *carry)
    return conform(out, SALES_SCHEMA, carry)


def clean_store_sales(raw: DataFrame, file_id, data_type: str | None = None,
                      carry: tuple[str, ...] = ()) -> DataFrame:
    """S8 cleaning: store/day lines of one file.

    Drops store sub-total rows (C9), splits the classification (C1), turns
    the mixed date into a date (C5) and parses every measure (C2). A
    ``data_type`` column in the input (S2) wins over the argument.
    """
    df = rename_headers(raw, STORE_HEADERS)
    store = F.col("store") if "store" in df.columns else F.lit(None).cast("string")
    df = C.with_classification(df.filter(C.keep_store_line(store)))
    if "sale_date" in df.columns:
        df = C.with_sale_date(df, "sale_date", "sale_date")
    dtype = F.col("data_type") if "data_type" in df.columns else F.lit(data_type).cast("string")
    date = F.col("sale_date") if "sale_date" in df.columns else F.lit(None)
    keep = [c for c in ("store_code", "store", "classification", "product_code", "product_name")
            if c in df.columns]
    df, measures = _with_measures(df, STORE_SALES_SCHEMA)
    out = df.select(_file_id(file_id).alias("file_id"), dtype.alias("data_type"),
                    date.cast("date").alias("sale_date"), *keep, "category", "supplier", *measures, *carry)
    return conform(out, STORE_SALES_SCHEMA, carry)


def save_sales(store: TableStore, raw: DataFrame, file_id: int) -> int:
    """Clean and append sales lines, with row ids and the load time;
    returns the inserted row count."""
    lines, n = with_row_ids(store, "sales", clean_sales(raw, file_id))
    store.append("sales", lines, ["file_id"])
    return n


STORE_PARTS = ["file_id", "sale_year"]  # partitions of the store table


def store_layout(df: DataFrame) -> DataFrame:
    """How store lines are written: with the sale year as a partition column
    (null for lines without a date), and in day order inside each file, so
    that date filters prune partitions and skip row groups (a per-task sort,
    no shuffle)."""
    return df.withColumn("sale_year", F.year("sale_date")).sortWithinPartitions("file_id", "sale_year", "sale_date")


def stored_between(store: TableStore, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Store lines of a date range (F2), pruned by sale year."""
    where = F.lit(True)
    for day, keep in ((start_date, lambda c, d: c >= d), (end_date, lambda c, d: c <= d)):
        if day:
            where = where & keep(F.col("sale_date"), F.lit(day).cast("date")) & keep(F.col("sale_year"), F.lit(int(day[:4])))
    return store.read("store_sales", STORE_SALES_SCHEMA, where)


def save_store_sales(store: TableStore, raw: DataFrame, file_id: int,
                     data_type: str | None = None) -> int:
    """Clean and append store/day lines, with row ids and the load time;
    returns the inserted row count."""
    lines, n = with_row_ids(store, "store_sales", clean_store_sales(raw, file_id, data_type))
    store.append("store_sales", store_layout(lines), STORE_PARTS)
    return n


# --- S9 / S10: catalog and stock --------------------------------------------------------------
def clean_catalog(raw: DataFrame, image_base_url: str, clip_keys: bool = False) -> DataFrame:
    """S9 cleaning: resolve headers (S5), zero-pad numeric codes (C10), drop
    rows without code or option (C15), clip and strip text (C14), build the
    image address (C11). The join keys (code, option) keep their whole text;
    ``clip_keys`` cuts them to the source's field widths too, which merges
    keys that differ only beyond those."""
    m = resolve_headers(raw.columns, CATALOG_RULES)
    df = select_mapped(raw, m, ["product_code", "product_name", "supplier_option", "barcode"])
    code = C.padded_code(F.col("product_code"))
    so = C.ustrip(F.col("supplier_option").cast("string"))
    df = df.select(code.alias("code"), so.alias("so"), "product_name", "barcode")
    df = df.filter((F.col("code") != "") & F.col("so").isNotNull() & (F.col("so") != "")
                   & (F.col("so") != "nan"))
    out = df.select(
        (F.substring("so", 1, 200) if clip_keys else F.col("so")).alias("supplier_option"),
        (F.substring("code", 1, 50) if clip_keys else F.col("code")).alias("product_code"),
        C.clip("product_name", 200).alias("product_name"),
        C.clip("barcode", 50).alias("barcode"),
        C.image_url(image_base_url, F.col("code")).alias("image_url"))
    return conform(out, PRODUCT_IMAGES_SCHEMA)


def clean_inventory(raw: DataFrame, clip_keys: bool = False) -> DataFrame:
    """S10 cleaning: resolve headers (S6), drop rows without a code (C15),
    clip text (C14; the keys only with ``clip_keys``, see
    ``clean_catalog``), tolerant numbers with 0 fallback (C12), sold-out flag
    (C13)."""
    m = resolve_headers(raw.columns, STOCK_RULES)
    df = select_mapped(raw, m, list(dict.fromkeys(r.target for r in STOCK_RULES)))
    code = C.ustrip(F.col("product_code").cast("string"))
    df = df.withColumn("product_code", code).filter(
        F.col("product_code").isNotNull() & (F.col("product_code") != "")
        & (F.col("product_code") != "nan"))
    out = df.select(
        (F.substring("product_code", 1, 50) if clip_keys else F.col("product_code")).alias("product_code"),
        C.clip("supplier", 100).alias("supplier"),
        C.clip("product_name", 200).alias("product_name"),
        C.clip("option_name", 100).alias("option_name"),
        C.number_or_zero("supply_price").alias("supply_price"),
        C.number_or_zero("sale_price").alias("sale_price"),
        (C.clip("supplier_option", 200) if clip_keys else C.ustrip("supplier_option")).alias("supplier_option"),
        C.clip("barcode", 50).alias("barcode"),
        C.int_or_zero("normal_stock").alias("normal_stock"),
        C.int_or_zero("available_stock").alias("available_stock"),
        C.soldout_flag("is_soldout").alias("is_soldout"))
    return conform(out, INVENTORY_SCHEMA)


def load_catalog(store: TableStore, raw: DataFrame, image_base_url: str) -> int:
    """Replace the catalog table; returns the stored row count."""
    obs = Observation("catalog_rows")
    store.replace("product_images", clean_catalog(raw, image_base_url)
                  .observe(obs, F.count(F.lit(1)).alias("n")))
    return int(obs.get.get("n", 0))


def load_inventory(store: TableStore, raw: DataFrame) -> int:
    """Replace the stock table; returns the stored row count."""
    obs = Observation("inventory_rows")
    store.replace("inventory", clean_inventory(raw).observe(obs, F.count(F.lit(1)).alias("n")))
    return int(obs.get.get("n", 0))


class Loaded(NamedTuple):
    """What a load did: the file's id, the lines inserted and the records
    that did not fit the header."""

    file_id: int
    inserted: int
    rejected: int


def load_file(store: TableStore, path: str | dict[str, str], file_type: str = "original",
              original_name: str | None = None, encoding: str = "utf-8") -> Loaded:
    """The whole upload of one file: read, register, clean, append, count.

    ``file_type`` 'original' / 'custom' load sales lines from one delimited
    file (``.xls`` exports read as tab-separated); 'monthly' loads store/day
    lines from ``{sheet name: path}`` with each sheet's data type. The file
    is registered (T1) first and its row count set from the rows written (T2).
    Records that do not fit the header are counted while the others are
    written; ``read_records(...).rejected()`` lists them.
    """
    from ..operators import maintain as M

    spark = store.spark
    name = original_name or (path if isinstance(path, str) else ",".join(path))
    seen: list[Observation] = []

    def accepted(one: str, sep: str) -> DataFrame:
        found = read_records(spark, one, sep, encoding)
        seen.append(Observation(f"rejected_{len(seen)}"))
        watched = found.cells.observe(seen[-1], F.count("reason").alias("n"))
        return Records(found.header, watched).accepted()

    fid = M.register_file(store, name, name, file_type)
    if file_type == "monthly":
        sheets = path if isinstance(path, dict) else {"sheet": path}
        n = save_store_sales(store, _sheets(sheets, lambda one: accepted(one, ",")), fid)
    else:
        n = save_sales(store, accepted(path, separator(path)), fid)
    M.set_row_count(store, fid, n)
    return Loaded(fid, n, sum(int(x.get.get("n", 0)) for x in seen))
