"""All registered queries: each module of plans holds QUERIES and SQL, keyed alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from websheaf.plans import fusion, ingest, logs, markup, more, reports, sites, text, urls

FLAGSHIP = "a01_engine_pools"
_MODULES = (fusion, logs, ingest, text, urls, reports, more, sites, markup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
