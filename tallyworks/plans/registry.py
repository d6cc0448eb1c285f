"""Query registry: a name, a function of the views, and an optional check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.sources.views import AS_OF, EVENTS_AS_OF, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Shared common table expressions of the check queries.
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(views)`` under ``name`` with its check query."""

    def wrap(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, CTES)
        return fn

    return wrap


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def events_as_of() -> Column:
    return F.lit(EVENTS_AS_OF).cast("date")


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    """Round floating columns for comparison: scale, round to whole, unscale."""
    k = 10.0**places
    return df.withColumns({c: F.round(F.col(c) * k) / k for c in cols})


def as_text(df: DataFrame, *cols: str) -> DataFrame:
    """Dates and numbers as text, arrays joined with ', '."""
    kinds = dict(df.dtypes)
    out = {}
    for c in cols:
        if kinds[c].startswith("array"):
            out[c] = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
        else:
            out[c] = F.col(c).cast("string")
    return df.withColumns(out)
