"""Where queries and their reference SQL are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with SQL that gives the same rows when there is any."""

    def register(function: Query) -> Query:
        if function.__name__ in QUERIES:
            raise ValueError(f"query {function.__name__} exists")
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round floating columns (the order of a distributed sum is free) and turn -0.0 into 0.0."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            columns.append((F.round(F.col(f.name).cast("double"), special.get(f.name, digits)) + 0.0).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            columns.append(F.col(f.name).cast("long").alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
