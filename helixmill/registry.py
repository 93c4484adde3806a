"""Where queries and their SQL equivalents are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.plans.proxies import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a query; the oracle's SQL may use the proxy views named."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = (with_views(*views) if views else "") + sql
        return function

    return add


def r(column, digits: int = 6):
    return F.round(column, digits)
