"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines, whole numbers as BIGINT."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(f"`{field.name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def r(*names: str) -> str:
    """SQL list of columns rounded in the same way."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def b(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)
