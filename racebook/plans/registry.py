"""Name -> query and name -> check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racebook.sources.adapters import Source, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(source) -> DataFrame`` under ``name`` with its check SQL."""

    def wrap(fn: Callable[[Source], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return wrap


def r6(c: Column | str) -> Column:
    """Six places with the same arithmetic as ``R6`` in the check SQL.

    The offset is a little over a half: values that are exactly halfway but for their last bit
    then round the same way on both sides.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.50001) / 1e6


def R6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 50001e-5) / 1e6"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})
