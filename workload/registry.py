"""Collects queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Inputs`; `sql` may use the portable views."""

    def add(function: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return add
