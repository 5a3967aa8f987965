"""Registry of named queries, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import roles

_QUERIES: dict[str, Callable[[roles.Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``$role`` in ``sql`` stands for that role's sub-select."""
    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = re.sub(r"\$(\w+)", lambda m: roles.SQL[m.group(1)], sql).strip()
        return fn
    return register


def _load() -> None:
    import importlib

    for module in ("metering", "tables", "records", "texts", "search", "streams"):
        importlib.import_module(f"ledgerlens.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(roles.Tables(spark, root))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
