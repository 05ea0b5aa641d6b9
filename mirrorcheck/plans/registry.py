"""Collects the queries: a Spark callable by name and, where SQL can say it, the SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles
from ..sources.fixtures import ClinicalTables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame``; doubles are rounded on the way out."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(ClinicalTables(spark, sf_dir)), digits)

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
