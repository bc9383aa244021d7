"""Table schemas and the header names of the input files.

Internal columns use English snake_case (Spark SQL needs backticks for
Hangul identifiers); input files carry Korean headers, mapped here.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Input header -> internal column name. The Korean headers are
# the ones the sales exports carry and must match exactly.
# ---------------------------------------------------------------------------
SALES_HEADERS = {
    "분류명": "classification",
    "카테고리": "category",
    "업체명": "supplier",
    "상품코드": "product_code",
    "바코드": "barcode",
    "상품명": "product_name",
    "판매일": "sale_days",
    "주문수": "order_units",
    "주문건": "order_count",
    "주문량": "order_qty",
    "판매단가": "unit_price",
    "최종단가": "final_unit_price",
    "수발주단가": "purchase_unit_price",
    "판매가": "list_amount",
    "취소수": "cancel_count",
    "취소량": "cancel_qty",
    "취소금액": "cancel_amount",
    "할인량": "discount_qty",
    "할인금액": "discount_amount",
    "판매량": "sold_qty",
    "실판매단가": "net_unit_price",
    "실판매금액": "net_sales",
}

STORE_HEADERS = {
    "판매일자": "sale_date",
    "매장코드": "store_code",
    "매장명": "store",
    **{k: v for k, v in SALES_HEADERS.items() if k not in ("바코드", "최종단가")},
}

# Labels the reference writes into its outputs.
UNASSIGNED_SUPPLIER = "미지정"   # classification without "(supplier)"
OTHER_LABEL = "기타"             # missing group / classification
NONE_LABEL = "(없음)"            # explorer key for empty values
STORE_SUBTOTAL_MARK = "매장수"   # store rows that are sub-totals
SUMMARY_ROW_MARK = "row(s)"      # product-name of summary lines

# Numeric measure columns (all but money are plain doubles).
MONEY_COLUMNS = ["unit_price", "final_unit_price", "purchase_unit_price", "list_amount",
                 "cancel_amount", "discount_amount", "net_unit_price", "net_sales"]
MONEY = T.DecimalType(28, 4)


def _measure_fields(skip=()):
    out = []
    for name in SALES_HEADERS.values():
        if name in skip or name in ("classification", "category", "supplier", "product_code",
                                    "barcode", "product_name"):
            continue
        out.append(T.StructField(name, MONEY if name in MONEY_COLUMNS else T.DoubleType()))
    return out


SALES_SCHEMA = T.StructType([
    T.StructField("file_id", T.IntegerType()),
    T.StructField("classification", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("product_name", T.StringType()),
    *_measure_fields(),
])

STORE_SALES_SCHEMA = T.StructType([
    T.StructField("file_id", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("sale_date", T.DateType()),
    T.StructField("store_code", T.StringType()),
    T.StructField("store", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("product_code", T.StringType()),
    T.StructField("product_name", T.StringType()),
    *_measure_fields(skip=("final_unit_price",)),
])

PRODUCT_IMAGES_SCHEMA = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("supplier_option", "product_code", "product_name", "barcode", "image_url")
])

INVENTORY_SCHEMA = T.StructType([
    T.StructField("product_code", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("option_name", T.StringType()),
    T.StructField("supply_price", T.DoubleType()),
    T.StructField("sale_price", T.DoubleType()),
    T.StructField("supplier_option", T.StringType()),
    T.StructField("barcode", T.StringType()),
    T.StructField("normal_stock", T.IntegerType()),
    T.StructField("available_stock", T.IntegerType()),
    T.StructField("is_soldout", T.IntegerType()),
    T.StructField("product_tag", T.StringType()),
    T.StructField("location", T.StringType()),
])

FILES_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("filename", T.StringType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("upload_date", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("data_period", T.StringType()),
])

# JSON chunk envelope of the chunked upload. Each row is a JSON object of
# header -> value; it is read as a struct of every known header (as text,
# numbers included), so unknown headers are ignored, as the loaders do.
CHUNK_HEADERS = list(dict.fromkeys([*SALES_HEADERS, *STORE_HEADERS]))
CHUNK_ROW = T.StructType([T.StructField(h, T.StringType()) for h in CHUNK_HEADERS])
CHUNK_SCHEMA = T.StructType([
    T.StructField("file_id", T.IntegerType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("rows", T.ArrayType(CHUNK_ROW)),
])
