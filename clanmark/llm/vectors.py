"""Whole-number vectors of a table, packed for numpy."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from clanmark.llm.base import col


def floored(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as LONG; null for a null vector, or one with a null or non-finite component."""
    components = F.transform(col(vector), lambda x: x.cast("double"))
    finite = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(components, lambda x: F.floor(x * scale).cast("long")))


def largest(dim: int, differences: bool = False) -> int:
    """The largest component with which products (or squared differences) of ``dim`` components stay below 2**62."""
    return isqrt((1 << (60 if differences else 62)) // max(1, dim))


def by_length(batch: pa.RecordBatch, vector: str, differences: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, rows) of the vectors of a batch, components clipped to ``largest``; empty ones are left out."""
    column = batch.column(vector)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        most = largest(dim, differences)
        yield dim, at, np.clip(flat.reshape(len(at), dim), -most, most).astype("<i8")


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), data]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str = "<i8") -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)
