"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.registry.sqltext import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL unless SQL cannot express it."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain_types(build(spark, folder))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return build

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and doubles at 6 digits, so that two engines agree."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def checksum(vector: str) -> Column:
    """Position-weighted sum of a vector: one number that changes with every element."""
    weighted = F.transform(vector, lambda x, i: x * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def checksum_sql(vector: str) -> str:
    return f"round(list_sum(list_transform(range(1, len({vector}) + 1), lambda k: {vector}[k] * k)), 6)"
