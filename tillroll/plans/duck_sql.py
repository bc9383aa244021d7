"""The cleaning rules restated in DuckDB SQL, for the oracles only.

DuckDB's ``trim`` strips spaces only; the fixture texts carry no other white
space, so that is enough for the check.
"""

from __future__ import annotations


def base_code(name: str) -> str:
    """C3 in DuckDB SQL."""
    s = f"trim({name})"
    head = f"trim(split_part({s}, '_', 1))"
    return (f"CASE WHEN {name} IS NULL OR {name} = '' THEN NULL ELSE coalesce("
            f"CASE WHEN strpos({s}, '_') > 0 AND regexp_full_match({head}, '[A-Za-z0-9]+') "
            f"THEN upper({head}) END, "
            f"upper(nullif(regexp_extract({s}, '^([A-Za-z]+[0-9]+[A-Za-z0-9]*)', 1), '')), "
            f"upper(nullif(regexp_extract({s}, '^([0-9]+[A-Za-z]+[A-Za-z0-9]*)', 1), ''))) END")


def option_label(name: str, base: str) -> str:
    """C4 in DuckDB SQL."""
    s = f"trim({name})"
    rest = f"trim(substr({s}, length({base}) + 1))"
    return (f"CASE WHEN {name} IS NULL OR {name} = '' OR {base} IS NULL OR {base} = '' THEN {name} "
            f"WHEN strpos({s}, '_') > 0 THEN trim(substr({s}, strpos({s}, '_') + 1)) "
            f"WHEN starts_with(upper({s}), {base}) THEN CASE WHEN {rest} <> '' THEN {rest} ELSE {s} END "
            f"ELSE {s} END")


def group_name(name: str) -> str:
    """C6 in DuckDB SQL."""
    last = f"string_split({name}, '_')[-1]"
    picked = (f"CASE WHEN strpos({last}, ']') < length({last}) "
              f"THEN trim(substr({last}, strpos({last}, ']') + 1)) "
              f"ELSE trim(substr({last}, 1, strpos({last}, '[') - 1)) END")
    return (f"CASE WHEN {name} IS NULL THEN NULL WHEN strpos({name}, '_') = 0 THEN {name} "
            f"WHEN strpos({last}, '[') > 0 AND strpos({last}, ']') > 0 "
            f"THEN coalesce(nullif({picked}, ''), {last}) ELSE {last} END")


# fixed values: the patterns of the classification and of numbers
CLASS_RE = r"(?s)^(.*)\(([^(]*)\)[^()]*$"
NUM_RE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def class_parts(c: str) -> tuple[str, str]:
    """C1 in DuckDB SQL: (category, supplier)."""
    s = f"trim({c})"
    has = f"regexp_matches({s}, '{CLASS_RE}')"
    cat = (f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL "
           f"WHEN {has} THEN trim(regexp_extract({s}, '{CLASS_RE}', 1)) ELSE {s} END")
    sup = (f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL "
           f"WHEN {has} THEN trim(regexp_extract({s}, '{CLASS_RE}', 2)) ELSE '미지정' END")
    return cat, sup


def to_number(c: str) -> str:
    """C2 in DuckDB SQL."""
    s = f"trim(replace({c}, ',', ''))"
    return f"CASE WHEN regexp_full_match({s}, '{NUM_RE}') THEN try_cast({s} AS double) END"


def to_money(c: str) -> str:
    """C2 in DuckDB SQL, exact."""
    s = f"trim(replace({c}, ',', ''))"
    return f"CASE WHEN regexp_full_match({s}, '{NUM_RE}') THEN try_cast({s} AS decimal(28,4)) END"


def to_date(c: str) -> str:
    """Mixed date text -> date for the layouts present in the fixture."""
    s = f"trim({c})"
    v = to_number(s)
    return (f"CASE WHEN {s} IS NULL OR {s} = '' THEN NULL "
            f"WHEN length({s}) >= 10 AND substr({s}, 5, 1) IN ('-', '/') "
            f"THEN cast(try_strptime(replace(substr({s}, 1, 10), '/', '-'), '%Y-%m-%d') AS date) "
            rf"WHEN regexp_full_match({s}, '\d{{8}}') THEN cast(try_strptime({s}, '%Y%m%d') AS date) "
            f"WHEN {v} > 1 AND {v} < 100000 THEN DATE '1899-12-30' + cast(trunc({v}) AS integer) "
            f"WHEN {v} IS NOT NULL AND abs({v}) < 9.2e9 THEN cast(make_timestamp(cast({v} * 1000000 AS bigint)) AS date) "
            f"ELSE NULL END")


def keep_sales_line(name: str) -> str:
    """C8 in DuckDB SQL."""
    return (f"({name} IS NOT NULL AND {name} <> '' AND {name} <> 'nan' "
            f"AND NOT contains({name}, 'row(s)'))")


def keep_store_line(store: str) -> str:
    """C9 in DuckDB SQL."""
    return f"({store} IS NULL OR NOT contains({store}, '매장수'))"


def typed_select(schema, exprs: dict[str, str]) -> str:
    """A SELECT list giving every schema column, typed nulls for the rest."""
    from pyspark.sql import types as T

    def duck_type(dt) -> str:
        if isinstance(dt, T.DecimalType):
            return f"DECIMAL({dt.precision},{dt.scale})"
        return {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE",
                "StringType": "VARCHAR", "DateType": "DATE",
                "TimestampType": "TIMESTAMP"}[type(dt).__name__]

    return ", ".join(f"cast({exprs.get(f.name, 'NULL')} AS {duck_type(f.dataType)}) AS {f.name}"
                     for f in schema.fields)
