"""Registry of runnable queries and the SQL an independent engine checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crashgrid.sources.star import PRELUDE, Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(star) -> DataFrame`` under ``name``; ``sql`` is its check query."""

    def register(fn: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Star(spark, sf_dir))
        if sql is not None:
            extra = f", {ctes}" if ctes else ""
            ORACLES[name] = f"{PRELUDE}{extra} {sql}"
        return fn

    return register
