"""Consecutive numbers and running sums over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.sources.workspace import materialize


def _running(keys: list[str], weight: str | None):
    """Per task: the running sum of each key of a sorted partition, and the task's number."""

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        new, n = np.zeros(batch.num_rows, dtype=bool), batch.num_rows
        for key in keys:
            here, before = batch.column(key).slice(1), batch.column(key).slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(here, before), False)
            new[1:] |= pc.or_(differ, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            total = np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(n, np.int64))
            new = changes(batch)
            first = tuple(batch.column(k)[0] for k in keys)
            bases = np.concatenate([[-carry if first == last else 0], total[np.flatnonzero(new) - 1]])
            sums = total - bases[np.cumsum(new)]
            carry, last = sums[-1], tuple(batch.column(k)[n - 1] for k in keys)
            more = [pa.array(np.full(n, part), pa.int32()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_slot", "_sum"])

    return run


def running_sum(
    df: DataFrame, order: list[Column], name: str, weight: str | None = None, keys: list[str] | None = None
) -> DataFrame:
    """``df`` plus ``name``: the sum of the LONG column ``weight`` (rows, if none) up to and with
    the row, per ``keys`` in ``order``, which must be a total order to give the same numbers again.

    Rows are range-partitioned, sorted and summed in one shuffle and written once.  A key of any
    size spreads over tasks; only keys that go on from an earlier task are shifted, one per task.
    """
    keys = keys or []
    order = [*[F.asc(k) for k in keys], *order]
    kind = T.StructType([*df.schema.fields, T.StructField("_slot", T.IntegerType()), T.StructField("_sum", T.LongType())])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running(keys, weight), kind)
    ranged = materialize(ranged, "ranged")
    sums = ranged.groupBy("_slot", *keys).agg(F.max("_sum").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_slot", *keys, F.sum("_rows").over(before).alias("_shift")).where("_shift <> 0")
    renamed = shifts.select(F.col("_slot").alias("_s"), "_shift", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = ranged["_slot"] == renamed["_s"]
    for i, key in enumerate(keys):
        same = same & ranged[key].eqNullSafe(renamed[f"_k{i}"])
    shifted = ranged.join(F.broadcast(renamed), same, "left")
    return shifted.select(*df.columns, (F.col("_sum") + F.coalesce("_shift", F.lit(0))).alias(name))


def number_rows(df: DataFrame, order: list[Column], name: str = "n", start: int = 0) -> DataFrame:
    """``df`` plus ``name`` = start, start+1, … in ``order``, which must be a total order."""
    numbered = running_sum(df, order, "_number")
    return numbered.withColumn(name, F.col("_number") + F.lit(start - 1)).drop("_number")


def first_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str | None = None) -> DataFrame:
    """The first ``k`` rows per key in ``order``; Spark keeps k per task before the shuffle."""
    rank = name or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(rank) <= k)
    return kept if name else kept.drop(rank)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` plus its rank per key, for keys of any size: a hot key is ranked by many tasks."""
    return running_sum(df, order, name, keys=keys)
