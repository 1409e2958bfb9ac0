"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans.views import Tables, with_views

_MODULES = ("numeric", "ranking", "text", "rollups", "graphs", "ledgers", "packages", "reports", "streams")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name; ``sql`` may use the views of loomwork.plans.views."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"loomwork.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
