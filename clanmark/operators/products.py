"""Vector joins that reduce inside the pair kernel: what leaves a unit grows with its answer, not its hits.

``similarity_groups`` keeps the best similarity and the number of hits per group of left rows and right row.
``best_products`` keeps one partner per left row, by the inner product of vectors of any length plus a
term of the partner; what a partner must reach as a cosine, term and lengths included, steers the visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.functions.sums import group_codes
from clanmark.functions.vectors import dimension_of, norm
from clanmark.operators import similarity as S
from clanmark.sources.workspace import materialize

#: Added to what a partner must reach: more than the rounding of products.
SLACK = 1e-9
#: Products are looked through in single precision up to here.
LARGEST = 1e30
#: Rows with more partners than so many within the error of single precision are compared in double precision.
NEAR_PARTNERS = 64


# ---------------------------------------------------------------- groups


def _reduced(keys: np.ndarray, best: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per key: largest value, number of hits."""
    order = np.argsort(keys, kind="stable")
    keys, starts = np.unique(keys[order], return_index=True)
    if not len(keys):
        return keys, best, hits
    return keys, np.maximum.reduceat(best[order], starts), np.add.reduceat(hits[order], starts)


def _group_rows(groups: pa.Array, r_ids: pa.Array, found: Iterator[tuple]) -> pa.RecordBatch:
    """(a, b, similarity, n) of the hits (left row, right row, similarity) of some left rows, slice by slice."""
    codes, first = group_codes([groups])
    width = max(1, len(r_ids))
    keys, best, hits = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for i, j, sims in found:
        own = _reduced(codes[i] * width + j, sims, np.ones(len(i), np.int64))
        keys, best, hits = _reduced(*(np.concatenate(x) for x in zip((keys, best, hits), own)))
    names, right = groups.take(pa.array(first[keys // width])), r_ids.take(pa.array(keys % width))
    return pa.RecordBatch.from_arrays([names, right, pa.array(best), pa.array(hits)], ["a", "b", "similarity", "n"])


def _groups_kernel(threshold: float, strict: bool):
    def kernel(table: pa.Table) -> pa.Table:
        l_ids, r_ids, values, left, right = S._cross_sides(table)
        found = S._hits(values[left], values[right], False, threshold, strict)
        return pa.Table.from_batches([_group_rows(l_ids.take(pa.array(left)), r_ids.take(pa.array(right)), found)])

    return kernel


def similarity_groups(
    left: DataFrame, right: DataFrame, group: str, left_key: str, left_vector: str, right_key: str, right_vector: str,
    threshold: float, strict: bool = False, broadcast_bytes: int = S.BROADCAST_BYTES,
    unit_rows_limit: int | None = None, pivots: int | None = None, dim: int | None = None,
) -> DataFrame:
    """(a, b, similarity, n): best similarity and number of left rows over the threshold, per group and right row.

    ``left_key`` only spreads the rows of a group over units.  A task hands on a row per group and right
    row at most, however many left rows match.
    """
    S._check_threshold(threshold)
    dim = dimension_of(right, right_vector) if dim is None else dim
    left, right = S._one_length(left, left_vector, dim), S._one_length(right, right_vector, dim)
    kind = S._pair_schema(left.schema[group].dataType, right.schema[right_key].dataType, ("a", "b"))
    kind = T.StructType([*kind.fields, T.StructField("n", T.LongType())])
    if S._fits_broadcast(right, right_key, right_vector, broadcast_bytes):
        parts = _groups_by_broadcast(left, right, (group, left_vector, right_key, right_vector), threshold, strict, kind)
    else:
        right, layout = S._place(right, right_key, right_vector, threshold, unit_rows_limit, pivots, False)
        layout = S._visited(left, left_vector, layout, False)
        visiting = S._spread(left, group, left_vector, layout, False, False, salt=left_key)
        at_home = S._spread(right, right_key, right_vector, layout, True, False)
        parts = S._run_units(S._common_ids((visiting, at_home)), _groups_kernel(threshold, strict), kind)
    return parts.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.sum("n").alias("n"))


def _groups_by_broadcast(left, right, names, threshold, strict, kind) -> DataFrame:
    group, left_vector, right_key, right_vector = names
    table = right.select(right_key, right_vector).toArrow()
    matrix, kept = S.unit_rows(table.column(1))
    ids = table.column(0).combine_chunks().take(pa.array(kept))
    shared = left.sparkSession.sparkContext.broadcast((ids, matrix))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r_ids, r_matrix = shared.value
        for batch in batches:
            l_matrix, rows = S.unit_rows(batch.column(1))
            if len(rows) and len(r_matrix):
                found = S._hits(l_matrix, r_matrix, False, threshold, strict)
                yield _group_rows(batch.column(0).take(pa.array(rows)), r_ids, found)

    return left.select(group, left_vector).mapInArrow(match, kind)


# ---------------------------------------------------------------- best products


def best_places(left: np.ndarray, right: np.ndarray, own: np.ndarray, over: float) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the largest product per left row over ``over``, at 12 places; -inf if there is none.

    The first of equals counts; ``own`` is the place that is left out (-1: none).  Single precision finds the rows
    within its error of the largest product, double precision decides; rows with many of those take the whole block.
    """
    best, value = np.zeros(len(left), np.int64), np.full(len(left), -np.inf)
    if not len(left) or not len(right):
        return best, value
    far = np.sqrt(np.einsum("ij,ij->i", left, left)), np.sqrt(np.einsum("ij,ij->i", right, right).max())
    if not far[0].max() * far[1] < LARGEST or not max(far[0].max(), far[1]) < LARGEST:
        return _best_in_double(left, right, own)
    margin = (left.shape[1] + 4) * 1.2e-7 * far[0] * far[1] + 2e-12  # equal at 12 places is equal
    single = right.astype(np.float32).T
    step = max(1, S.SCRATCH_ELEMENTS // len(right))
    for first in range(0, len(left), step):
        rows = slice(first, min(first + step, len(left)))
        rough = left[rows].astype(np.float32) @ single
        same = own[rows]
        rough[np.flatnonzero(same >= 0), same[same >= 0]] = -np.inf
        top, error = rough.max(axis=1).astype(np.float64), margin[rows]
        able = np.flatnonzero(top > over - error)
        if not len(able):
            continue
        near = (rough if len(able) == len(rough) else rough[able]) >= (top - 2 * error)[able, None].astype(np.float32)
        many = np.count_nonzero(near, axis=1) > NEAR_PARTNERS
        if many.any():
            dense = first + able[many]
            best[dense], value[dense] = _best_in_double(left[dense], right, own[dense])
            near[many] = False
        i, j = np.nonzero(near)
        if len(i):
            at = first + able[i]
            sims = np.round(np.einsum("ij,ij->i", left[at], right[j]), 12)
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            most = np.maximum.reduceat(sims, starts)
            hits = np.flatnonzero(sims == np.repeat(most, np.diff(np.append(starts, len(i)))))
            hits = hits[np.append(True, i[hits][1:] != i[hits][:-1])]
            best[at[hits]], value[at[hits]] = j[hits], sims[hits]
    return best, value


def _best_in_double(left: np.ndarray, right: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, value = np.zeros(len(left), np.int64), np.full(len(left), -np.inf)
    step = max(1, S.SCRATCH_ELEMENTS // len(right))
    for first in range(0, len(left), step):
        block = np.round(left[first : first + step] @ right.T, 12)
        same = own[first : first + step]
        block[np.flatnonzero(same >= 0), same[same >= 0]] = -np.inf
        best[first : first + step], value[first : first + step] = block.argmax(1), block.max(1)
    return best, value


def _best_rows(l_ids: pa.Array, left: np.ndarray, r_ids: pa.Array, right: np.ndarray, over: float | None, other: bool) -> pa.RecordBatch:
    """(a, b, similarity): the right row of the largest product per left row, the lower id of equals.

    ``other``: a row of the left row's own id is no partner.  ``right`` must be in the order of its ids.
    """
    own = np.asarray(pc.fill_null(pc.index_in(l_ids, r_ids), -1)) if other and len(r_ids) else np.full(len(left), -1)
    best, value = best_places(left, right, own, -np.inf if over is None else over)
    ok = np.flatnonzero(value > (-np.inf if over is None else over))
    columns = [l_ids.take(pa.array(ok)), r_ids.take(pa.array(best[ok])), pa.array(value[ok])]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"])


def _best_kernel(over: float | None, other: bool):
    def kernel(table: pa.Table) -> pa.Table:
        l_ids, r_ids, values, left, right = S._cross_sides(table)
        right = right[np.asarray(pc.sort_indices(r_ids.take(pa.array(right))))]
        rows = _best_rows(l_ids.take(pa.array(left)), values[left], r_ids.take(pa.array(right)), values[right], over, other)
        return pa.Table.from_batches([rows])

    return kernel


def _shipped(batch_vectors: pa.Array, lengths: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they were, with the term as one more component, and their positions."""
    matrix, kept = S.unit_rows(batch_vectors)
    lengths, terms = np.asarray(lengths)[kept], np.asarray(terms)[kept]
    return np.column_stack([matrix * lengths[:, None], terms]) if len(kept) else np.zeros((0, 1)), kept


def best_products(
    left: DataFrame, right: DataFrame, left_key: str, left_vector: str, right_key: str, right_vector: str,
    over: float, term: Column | None = None, other: bool = False, broadcast_bytes: int = S.BROADCAST_BYTES,
    unit_rows_limit: int | None = None, pivots: int | None = None, dim: int | None = None,
) -> DataFrame:
    """(a, b, similarity): per left row the right row of the largest inner product plus ``term`` of the right row.

    Only sums strictly over ``over`` count, at 12 places; ties go to the lower right id.  ``other``: rows
    of equal ids are no partners.  Vectors keep their lengths; null, zero and non-finite ones have no partner.

    With lengths up to L and terms up to T a partner's cosine must exceed (over - T) / (own length x L), and once
    a first partner around the row's own pivot is known, the same with that one's sum; a row visits only cells
    that can hold such a partner.  A unit returns one row per left row.
    """
    dim = dimension_of(right, right_vector) if dim is None else dim
    plain = F.lit(0.0) if term is None else F.coalesce(term.cast("double"), F.lit(0.0))
    left = S._one_length(left, left_vector, dim).select(F.col(left_key).alias("_a"), F.col(left_vector).alias("_v"))
    right = S._one_length(right, right_vector, dim).select(F.col(right_key).alias("_b"), F.col(right_vector).alias("_v"), plain.alias("_t"))
    left = left.select("*", norm("_v").alias("_l"), F.lit(1.0).alias("_t"))
    right = right.select("*", norm("_v").alias("_l"))
    kind = S._pair_schema(left.schema["_a"].dataType, right.schema["_b"].dataType, ("a", "b"))
    if S._fits_broadcast(right, "_b", "_v", broadcast_bytes):
        return _products_by_broadcast(left, right, over, other, kind)
    right = materialize(right, "partners")
    most = right.agg(F.max(F.when(~F.isnan("_l"), F.col("_l"))).alias("l"), F.max("_t").alias("t")).first()
    longest, largest = most["l"] or 0.0, most["t"] or 0.0

    def reach(score: Column) -> Column:
        """The cosine that a partner must have for a sum of ``score``; -1 where any may do."""
        needed = F.try_divide(score - largest, F.col("_l") * longest) - SLACK
        return F.greatest(F.coalesce(F.when(score > largest, needed), F.lit(-1.0)), F.lit(-1.0))

    left = left.withColumn("_bound", reach(F.lit(float(over)))).where("_bound <= 1")
    left = materialize(left, "visitors")
    floor = left.agg(F.min("_bound").alias("m")).first()["m"]
    right, layout = S._place(right, "_b", "_v", -1.0 if floor is None else float(floor), unit_rows_limit, pivots, False, ("_l", "_t"))

    def in_units(visitors: DataFrame, plan: S.Layout, bound: str | None) -> DataFrame:
        visiting = S._spread(visitors, "_a", "_v", plan, False, False, bound, "_l", "_t")
        at_home = S._spread(right, "_b", "_v", plan, True, False, None, "_l", "_t")
        found = S._run_units(S._common_ids((visiting, at_home)), _best_kernel(over, other), kind)
        first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("b"))).alias("m")
        return found.groupBy("a").agg(first).select("a", F.col("m.b").alias("b"), (-F.col("m.s")).alias("similarity"))

    if layout.pivots is not None:
        near = in_units(left, S._visited(left, "_v", S.replace(layout, own_pivot_only=True), False), None)
        near = near.select(F.col("a").alias("_a"), F.col("similarity").alias("_s"))
        joined = left.join(near, "_a", "left").withColumn("_bound", F.greatest("_bound", F.coalesce(reach(F.col("_s")), F.lit(-1.0))))
        left = materialize(joined.drop("_s"), "visitors")
    return in_units(left, S._visited(left, "_v", layout, False, "_bound"), "_bound")


def _products_by_broadcast(left, right, over, other, kind) -> DataFrame:
    table = right.select("_b", "_v", "_l", "_t").toArrow().combine_chunks()
    matrix, kept = _shipped(table.column("_v"), table.column("_l"), table.column("_t"))
    ids = table.column("_b").combine_chunks().take(pa.array(kept)) if table.num_rows else pa.array([], table.schema.field("_b").type)
    order = np.asarray(pc.sort_indices(ids))
    shared = left.sparkSession.sparkContext.broadcast((ids.take(pa.array(order)), matrix[order]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r_ids, r_matrix = shared.value
        for batch in batches:
            l_matrix, rows = _shipped(batch.column("_v"), batch.column("_l"), batch.column("_t"))
            if len(rows) and len(r_matrix):
                yield _best_rows(batch.column("_a").take(pa.array(rows)), l_matrix, r_ids, r_matrix, over, other)

    return left.select("_a", "_v", "_l", "_t").mapInArrow(match, kind)
