"""Sums of vectors per key: one buffer per key and task, whatever the dimension.

A map task adds the vectors of a key into one array and hands on a row per key and buffer; after the
shuffle the few rows of a key lie next to each other and are added once more.  The plan has the same
few nodes for 4 and for 4 096 dimensions, and a hot key costs a row per buffer, not a row per vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds in its buffers before it combines them, and hands them on if that does not help.
HELD = 4_000_000


def group_codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and a row of each group; nulls are one group, structs count by their fields."""
    codes = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        if pa.types.is_struct(column.type):
            inner = [column.is_null(), *[column.field(i) for i in range(column.type.num_fields)]]
            own, many = group_codes(inner)[0], len(column)
        else:
            encoded = column.dictionary_encode(null_encoding="encode")
            own, many = np.asarray(encoded.indices), len(encoded.dictionary)
        _, codes = np.unique(codes * (many + 1) + own, return_inverse=True)
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, first


def _combined(table: pa.Table, keys: list[str], counts: list[str], dim: int) -> tuple[pa.Table, int]:
    """One row per key, with counts and vectors (null: none) added up, and the number of the last row's key."""
    codes, first = group_codes([table.column(k).combine_chunks() for k in keys])
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(first)))
    column = table.column("_sum").combine_chunks()
    there = np.asarray(pc.is_valid(column))
    flat = column.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False)
    rows = np.zeros((table.num_rows, dim))
    rows[there] = flat.reshape(-1, dim) if dim else 0.0
    sums = np.add.reduceat(rows[order], starts, axis=0) if dim else np.zeros((len(first), 0))
    offsets = pa.array(np.arange(len(first) + 1, dtype=np.int32) * dim)
    columns = [table.column(k).combine_chunks().take(pa.array(first)) for k in keys]
    columns += [pa.array(np.add.reduceat(np.asarray(table.column(c).combine_chunks())[order], starts)) for c in counts]
    columns.append(pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())))
    return pa.table(columns, names=[*keys, *counts, "_sum"]), int(codes[-1])


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    for batch in batches:
        kinds = [(f.name, pa.list_(pa.float64()) if f.name == "_sum" else f.type) for f in batch.schema]
        for at in range(0, batch.num_rows, rows):
            yield pa.Table.from_batches([batch.slice(at, rows)]).cast(pa.schema(kinds))


def _before_shuffle(keys: list[str], counts: list[str], dim: int):
    """Adds up what a task has, in buffers of about ``HELD`` numbers."""
    most = max(1, HELD // max(1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in _slices(batches, most):
            held.append(_combined(part, keys, counts, dim)[0])
            if sum(t.num_rows for t in held) > most:
                held = [_combined(pa.concat_tables(held), keys, counts, dim)[0]]
                if held[0].num_rows > most // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _combined(pa.concat_tables(held), keys, counts, dim)[0].to_batches()

    return run


def _after_shuffle(keys: list[str], counts: list[str], dim: int):
    """Adds up rows in key order: a key is done when the next one begins."""
    most = max(1, HELD // max(1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None
        for part in _slices(batches, most):
            sums, last = _combined(part if open_key is None else pa.concat_tables([open_key, part]), keys, counts, dim)
            yield from pa.concat_tables([sums.slice(0, last), sums.slice(last + 1)]).to_batches()
            open_key = sums.slice(last, 1)
        if open_key is not None:
            yield from open_key.to_batches()

    return run


def vector_sums(
    df: DataFrame, keys: list[str], vector: str, dim: int, counts: dict[str, Column] | None = None
) -> DataFrame:
    """(keys, counts, ``_sum``) per key: the sum of the vectors of ``dim`` elements.

    ``counts`` are further LONG or DOUBLE columns to add up.  Vectors of another length are left out of
    the sum, their rows still count; a key without any vector has zeros.  Null elements add nothing and
    a null key is a key of its own.
    """
    counts = counts or {}
    doubles = F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
    own = F.when(F.size(vector) == dim, doubles)
    rows = df.select(*keys, *[c.alias(name) for name, c in counts.items()], own.alias("_sum"))
    parts = rows.mapInArrow(_before_shuffle(keys, list(counts), dim), rows.schema)
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_after_shuffle(keys, list(counts), dim), rows.schema)
