"""Ad-hoc explorer: any column by any measure, profile, top items, months.

The source ships up to 100 000 rows to the browser and aggregates them in
JavaScript. Here every view is one aggregate that stays on the cluster; only
the few result rows (top 20, 13 month rows, one profile) come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import is_number_text, number_text, to_number
from ..schemas import NONE_LABEL

COUNT_MEASURE = "_count"

# Month column headers of a wide table, and the total label.
MONTH_COLUMNS = ["1월", "2월", "3월", "4월", "5월", "6월", "7월", "8월", "9월", "10월", "11월", "12월"]
TOTAL_LABEL = "합계"


def _dtype(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def js_text(c: Column, dt: T.DataType) -> Column:
    """A value as JavaScript would print it as an object key."""
    if isinstance(dt, T.StringType):
        return c
    if _is_numeric(dt):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def _quoted(c: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + c.replace("`", "``") + "`")


def _falsy(col: Column, dt: T.DataType) -> Column:
    """Null, '', 0, NaN and false."""
    if _is_numeric(dt):
        return col.isNull() | (col == 0) | F.isnan(col.cast("double"))
    if isinstance(dt, T.BooleanType):
        return col.isNull() | ~col
    return col.isNull() | (col.cast("string") == "")


def group_key(df: DataFrame, c: str) -> Column:
    """C22 key: falsy values (null, '', 0, NaN) become the "(none)" label."""
    col, dt = _quoted(c), _dtype(df, c)
    return F.when(_falsy(col, dt), F.lit(NONE_LABEL)).otherwise(js_text(col, dt))


def measure(df: DataFrame, c: str) -> Column:
    """C22 measure: ``parseFloat(v) || 0``; the row-count measure is 1."""
    if c == COUNT_MEASURE:
        return F.lit(1.0)
    dt = _dtype(df, c)
    if isinstance(dt, T.DecimalType):
        return F.coalesce(_quoted(c), F.lit(0).cast(dt))
    v = _quoted(c).cast("double") if _is_numeric(dt) else to_number(_quoted(c))
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


# --- X1 / W5 ------------------------------------------------------------------------
def group_measure(df: DataFrame, group_col: str, value_col: str = COUNT_MEASURE,
                  agg: str = "sum", top: int = 20) -> DataFrame:
    """Group any column by any measure (sum / count / avg / max).

    Null and unparsable measures count as 0, so they weigh in avg and max.
    Result: the top ``top`` keys by value (ties: key), ranked 1..top.
    """
    m = measure(df, value_col)
    fn = {"sum": F.sum, "avg": F.avg, "max": F.max}.get(agg)
    if agg == "count":
        val = F.count(F.lit(1)).cast("double")
    elif fn is None:
        raise ValueError(f"unknown aggregate {agg}")
    else:
        val = fn(m).cast("double")
    out = (df.groupBy(group_key(df, group_col).alias("key")).agg(val.alias("value"))
           .orderBy(F.col("value").desc(), F.col("key").asc()).limit(top))
    # rank labels over at most ``top`` rows
    return out.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("value").desc(), F.col("key").asc())).cast("long"))


# --- X3 --------------------------------------------------------------------------------
def column_roles(df: DataFrame) -> DataFrame:
    """Per column, whether any value is a number and whether any is text.

    Typed columns are decided by their type and a non-null value; all-string
    columns by parsing every value (one aggregate pass for all columns).
    Result rows: (position, column_name, is_numeric, is_text).
    """
    # each text is prepared, then tested, once (projections below the aggregate)
    texts = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    staged = df.select(*[_quoted(f.name).isNotNull().alias(f"v{i}") for i, f in enumerate(df.schema.fields)],
                       *[number_text(_quoted(df.schema[i].name)).alias(f"t{i}") for i in texts])
    parsed = staged.select(*[f"v{i}" for i in range(len(df.columns))],
                           *[(F.coalesce(is_number_text(F.col(f"t{i}")), F.lit(False)) if i in texts
                              else F.col(f"v{i}")).alias(f"p{i}") for i in range(len(df.columns))])
    aggs = []
    for i, f in enumerate(df.schema.fields):
        p, v = F.col(f"p{i}"), F.col(f"v{i}")
        if isinstance(f.dataType, T.StringType):
            num, txt = F.max(p), F.max(v & ~p)
        elif _is_numeric(f.dataType):
            num, txt = F.max(v), F.lit(False)
        else:
            num, txt = F.lit(False), F.max(v)
        aggs += [F.coalesce(num, F.lit(False)).alias(f"n{i}"),
                 F.coalesce(txt, F.lit(False)).alias(f"t{i}")]
    one = parsed.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                     F.col(f"n{i}").alias("is_numeric"), F.col(f"t{i}").alias("is_text"))
            for i, f in enumerate(df.schema.fields)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# --- X2 ----------------------------------------------------------------------------------
def profile(df: DataFrame, max_sums: int = 4) -> DataFrame:
    """Row count, column count and the sums of the first ``max_sums``
    numeric columns that hold a value.

    Rows: (stat, column_name, value) with stat in rows / columns / sum.
    Decimal columns are summed exactly and returned as double.
    """
    numeric = [f.name for f in df.schema.fields if _is_numeric(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(numeric):
        aggs += [F.count(_quoted(c)).alias(f"c{i}"),
                 F.coalesce(F.sum(measure(df, c)), F.lit(0)).cast("double").alias(f"s{i}")]
    one = df.agg(*aggs)
    head = one.select(F.lit("rows").alias("stat"), F.lit(None).cast("string").alias("column_name"),
                      F.col("_rows").cast("double").alias("value"),
                      F.lit(0).alias("position"))
    cols = one.select(F.lit("columns").alias("stat"), F.lit(None).cast("string").alias("column_name"),
                      F.lit(float(len(df.columns))).alias("value"), F.lit(0).alias("position"))
    out = head.unionByName(cols)
    if numeric:
        stats = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                          F.col(f"c{i}").alias("n"), F.col(f"s{i}").alias("value")) for i, c in enumerate(numeric)]
        sums = one.select(F.explode(F.array(*stats)).alias("r")).select("r.*").filter(F.col("n") > 0)
        # at most len(columns) rows: a bounded window
        sums = (sums.withColumn("_k", F.row_number().over(Window.orderBy("position")))
                .filter(F.col("_k") <= max_sums)
                .select(F.lit("sum").alias("stat"), "column_name", "value", "position"))
        out = out.unionByName(sums)
    return out


# --- X4 -------------------------------------------------------------------------------------
def top_items(df: DataFrame, value_col: str = COUNT_MEASURE, name_col: str = "product_name",
              top: int = 20) -> DataFrame:
    """The name column (or the first column when the name is empty) by
    the summed measure; top ``top`` (ties: name), ranked."""
    first = df.columns[0]
    key = js_text(_quoted(first), _dtype(df, first))
    if name_col in df.columns:
        name, kind = _quoted(name_col), _dtype(df, name_col)
        key = F.coalesce(F.when(~_falsy(name, kind), js_text(name, kind)), key)
    out = (df.groupBy(key.alias("name")).agg(F.sum(measure(df, value_col)).cast("double").alias("value"))
           .orderBy(F.col("value").desc(), F.col("name").asc_nulls_first()).limit(top))
    return out.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("value").desc(), F.col("name").asc_nulls_first())).cast("long"))


# --- X5 / W4 ----------------------------------------------------------------------------------
def monthly_view(df: DataFrame) -> DataFrame:
    """Per-month totals of a wide ``1월``..``12월`` table.

    One aggregate pass; absent months are 0; share of the grand total in
    percent with one decimal (0 when the total is 0); a final total row with
    share 100. No month column at all gives no rows.
    """
    present = [m for m in MONTH_COLUMNS if m in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "position int, month string, qty double, share double")
    sums = df.agg(*[F.sum(measure(df, m)).cast("double").alias(f"m{i}")
                    for i, m in enumerate(MONTH_COLUMNS) if m in present])
    vals = [F.coalesce(F.col(f"m{i}"), F.lit(0.0)) if m in present else F.lit(0.0)
            for i, m in enumerate(MONTH_COLUMNS)]
    total = vals[0]
    for v in vals[1:]:
        total = total + v
    rows = sums.select(*[v.alias(f"v{i}") for i, v in enumerate(vals)], total.alias("total"))
    parts = ", ".join(f"{i + 1}, '{m}', v{i}" for i, m in enumerate(MONTH_COLUMNS))
    months = rows.selectExpr("total", f"stack(12, {parts}) AS (position, month, qty)")
    months = months.select("position", "month", "qty", F.when(
        F.col("total") > 0, F.round(F.col("qty") / F.col("total") * 100, 1)).otherwise(0.0)
        .alias("share"))
    total_row = rows.select(F.lit(13).alias("position"), F.lit(TOTAL_LABEL).alias("month"),
                            F.col("total").alias("qty"), F.lit(100.0).alias("share"))
    return months.unionByName(total_row)


def with_share(df: DataFrame, value_col: str, out: str = "share") -> DataFrame:
    """Percent share of the grand total, one decimal, 0 when the total is
    0. The total is a scalar subquery, evaluated once, not a window."""
    total = df.agg(F.sum(value_col)).scalar()
    return df.withColumn(out, F.when(total > 0, F.round(F.col(value_col) / total * 100, 1))
                         .otherwise(F.lit(0.0)))


# --- X6 / O3 -----------------------------------------------------------------------------------
def preview(df: DataFrame, n: int = 500, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (in ``order_by`` order when given)."""
    if order_by:
        df = df.orderBy(*[_quoted(c).asc_nulls_first() for c in order_by])
    return df.limit(n)


def page(df: DataFrame, order_by: list[str], page_no: int = 1, size: int = 50) -> DataFrame:
    """O3: one page of ``size`` rows in a total order (1-based page)."""
    order = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order_by]
    return df.orderBy(*order).offset((max(page_no, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, order_by: list[str], last: dict | None, size: int = 50) -> DataFrame:
    """O3 by key: the ``size`` rows that follow the row with the key ``last``
    ({column: value}; None: from the start) in the order of ``order_by``
    (ascending, nulls first). Every task keeps its own first ``size`` rows, so a
    deep page costs no more than the first; the columns should identify a
    row, as equal keys are passed over together."""
    if last is not None:
        later, same = F.lit(False), F.lit(True)
        for c in order_by:
            v = last[c]
            col = _quoted(c)
            later = later | (same & (col.isNotNull() if v is None else F.coalesce(col > F.lit(v), F.lit(False))))
            same = same & col.eqNullSafe(F.lit(v))
        df = df.filter(later)
    return df.orderBy(*[_quoted(c).asc_nulls_first() for c in order_by]).limit(size)


def page_count(df: DataFrame, size: int = 50) -> DataFrame:
    """O3: number of pages of ``size`` rows."""
    return df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("pages"))
