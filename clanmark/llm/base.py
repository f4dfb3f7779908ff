"""The table of this package's queries, and what its operators share."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from types import ModuleType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL where SQL can express it."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return build

    return register


def load() -> ModuleType:
    importlib.import_module("clanmark.llm.queries")
    return importlib.import_module("clanmark.llm.base")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name can clash with those of an operator."""
    return F.struct(*[col(c) for c in df.columns])


def schema(text: str, /, **more: T.DataType) -> T.StructType:
    """The fields of a DDL text and then others."""
    return T.StructType([*T.StructType.fromDDL(text).fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def strings(column: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty) and without an offset into its buffers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column, column.slice(0, 0)])
