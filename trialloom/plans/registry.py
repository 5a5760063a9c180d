"""Named queries over the test tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trialloom.plans.sql_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{view}`` names in ``sql`` become common table expressions."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round doubles, since the last digits of a sum depend on the order of its rows."""
    columns = [
        f"round(`{f.name}`, {digits}) as `{f.name}`" if f.dataType == T.DoubleType() else f"`{f.name}`"
        for f in df.schema.fields
    ]
    return df.selectExpr(*columns)
