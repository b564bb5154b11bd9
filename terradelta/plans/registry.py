"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terradelta.fixtures import VIEWS, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a function of (spark, sf_dir) or, with views named, of these views in order."""

    def add(f):
        names = views.split()
        QUERIES[name] = (lambda spark, sf_dir: f(*[VIEWS[v](spark, sf_dir) for v in names])) if names else f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *names) if names else sql
        return f

    return add
