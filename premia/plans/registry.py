"""Registry of runnable queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    """Register a query; the session settings it relies on are set before it runs."""

    def register(run: Query) -> Query:
        def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(apply_settings(spark), sf_dir)

        with_settings.__name__ = name
        QUERIES[name] = with_settings
        return run

    return register


def r4(column) -> Column:
    """Four decimals, rounded the way the checks round."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * 1e4 + 0.5) / 1e4


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r4(c) for c in columns})
