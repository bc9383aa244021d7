"""Registry of named queries: the library operator applied to the fixture
views, plus the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, duck_with


@dataclass
class Entry:
    name: str
    build: Callable[[Fixtures], DataFrame]
    sql: str | None = None
    views: list[str] = field(default_factory=list)
    doc: str = ""


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``.

    ``sql`` is DuckDB SQL over the base tables; ``views`` are the fixture
    views it reads, emitted as a WITH clause ahead of it.
    """
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, list(views), (fn.__doc__ or "").strip())
        return fn
    return deco


def _load_all() -> None:
    # import for the registration side effect
    from . import (catalog_queries, clean_queries, drill_queries, explore_queries,  # noqa: F401
                   io_queries, sales_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query as ``(spark, sf_dir) -> DataFrame``."""
    _load_all()

    def bind(e: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return e.build(Fixtures(spark, sf_dir))
        run.__name__ = e.name
        run.__doc__ = e.doc
        return run

    return {name: bind(e) for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query: the fixture views as a WITH clause, then the query."""
    _load_all()
    return {name: duck_with(e.views) + e.sql.strip() for name, e in REGISTRY.items() if e.sql}
