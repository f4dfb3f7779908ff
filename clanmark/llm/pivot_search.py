"""Exact top-k by inner product with pivot-table elimination.

For every vector the table holds its distances to many pivots.  By the triangle inequality the
distance of a query and a candidate is at least the largest difference of their distances to a
pivot, so ``(|q|^2 + |x|^2 - bound^2) / 2`` is an upper bound of their inner product.  Candidates are
evaluated in the order of that bound, and a query stops when the next bound cannot reach its k-th
score any more.  The pivots steer the order only: the result is exact for any choice of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clanmark.llm.base import col
from clanmark.sources.workspace import materialize

#: Pivots: rows with the lowest hash of their id, so a bounded sample that rests on the data alone.
PIVOTS = 32
#: Bytes of the queries that one pass over the table broadcasts.
QUERY_BYTES = 8 << 20
#: Bytes of candidates that a task bounds at once, and bound values held at once.
BLOCK_ROWS = 4096
BLOCK_CELLS = 1 << 21
#: Candidates that a query evaluates at a time before it looks at its k-th score again.
STEP = 64
#: Added to the bounds: more than the rounding of distances below 2**24, and a share of the squares for longer ones.
SLACK, ROUNDED = 1.0, 1e-9
#: Sums of two squares up to which products are exact as doubles.
EXACT = 2.0**53

TABLE = "vec_id long, dim int, vec binary, pivots binary"
HITS = "query_id long, vec_id long, score long"


def scaled(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a DOUBLE; null where a component is null or not finite."""
    components = F.transform(col(vector), lambda x: x.cast("double"))
    finite = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(components, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<i8").reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances; products of whole numbers stay exact in float64 below 2**53."""
    x, p = vectors.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
    return np.sqrt(np.maximum(square, 0.0))


def _table_of(pivots: dict[int, np.ndarray]):
    """The rows of the pivot table: packed vectors and their distances to the pivots of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("vec_id"), batch.column("vector")
            sizes = np.asarray(pc.list_value_length(vectors))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                own = vectors.take(pa.array(at))
                rows = own.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(at), dim)
                near = _distances(rows, pivots.get(dim, rows[:0])).astype("<f8")
                columns = [
                    ids.take(pa.array(at)),
                    pa.array(np.full(len(at), dim), pa.int32()),
                    pa.array([x.tobytes() for x in rows], pa.binary()),
                    pa.array([x.tobytes() for x in near], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "vec", "pivots"])

    return run


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, dim, vec, pivots) of rows (vec_id, vector of whole numbers), written once.

    The driver holds ``pivots`` vectors of the length of most rows; other lengths have no pivots, and
    the lengths of the vectors alone bound their products.
    """
    usual = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    chosen = {}
    if usual is not None and usual.dim > 0:
        own = vectors.where(F.size("vector") == usual.dim)
        rows = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vector").collect()
        chosen[usual.dim] = np.array([r.vector for r in rows], dtype=np.int64)
    return materialize(vectors.mapInArrow(_table_of(chosen), TABLE), "pivots")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then lowest id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
        return among[np.lexsort((ids[among], -scores[among]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class _Queries:
    """The queries of a pass in one length, with the k best of what a task has seen."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.vectors, self.pivots, self.k = ids, vectors.astype(np.float64), pivots, k
        self.whole = vectors.astype(np.int64)
        self.squares = (self.vectors**2).sum(1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def _kth(self, q: int) -> tuple[float, float]:
        ids, scores = self.best[q]
        return (-np.inf, np.inf) if len(ids) < self.k else (scores[-1], ids[-1])

    def see(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> None:
        """Evaluate a block of candidates in bound order, each query until its exact stop."""
        x = vectors.astype(np.float64)
        squares = (x * x).sum(1)
        for first in range(0, len(self.ids), step := max(1, BLOCK_CELLS // max(1, len(ids)))):
            some = slice(first, first + step)
            far = np.zeros((len(self.ids[some]), len(ids)))
            if pivots.shape[1] == self.pivots.shape[1] and len(self.ids):
                for p in range(pivots.shape[1]):
                    np.maximum(far, np.abs(self.pivots[some, p][:, None] - pivots[None, :, p]), out=far)
            size = self.squares[some][:, None] + squares[None, :]
            bounds = (size - far * far) / 2.0 + SLACK + ROUNDED * size
            for q in range(first, first + len(bounds)):
                # |q . x| is at most (|q|^2 + |x|^2) / 2, so beyond 2**53 products are made in whole numbers
                large = size[q - first].max(initial=0.0) > EXACT
                self._evaluate(q, ids, vectors if large else x, bounds[q - first])

    def _evaluate(self, q: int, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> None:
        query = self.whole[q] if x.dtype == np.int64 else self.vectors[q]
        kth, last = self._kth(q)
        able = np.flatnonzero(bounds >= kth)
        order = able[np.argsort(-bounds[able], kind="stable")]
        for at in range(0, len(order), STEP):
            if bounds[order[at]] < kth:
                break
            some = order[at : at + STEP]
            scores = x[some] @ query
            if x.dtype != np.int64:
                scores = np.rint(scores).astype(np.int64)
            good = (ids[some] != self.ids[q]) & ((scores > kth) | ((scores == kth) & (ids[some] < last)))
            if good.any():
                own_ids = np.concatenate([self.best[q][0], ids[some][good]])
                own_scores = np.concatenate([self.best[q][1], scores[good]])
                keep = _top(own_ids, own_scores, self.k)
                self.best[q] = own_ids[keep], own_scores[keep]
                kth, last = self._kth(q)

    def hits(self) -> pa.RecordBatch:
        counts = [len(ids) for ids, _ in self.best]
        columns = [
            pa.array(np.repeat(self.ids, counts), pa.int64()),
            pa.array(np.concatenate([ids for ids, _ in self.best]), pa.int64()),
            pa.array(np.concatenate([scores for _, scores in self.best]), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {dim: _Queries(*rows, k) for dim, rows in queries.value.items()}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in own:
                at = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(at)
                for first in range(0, part.num_rows, BLOCK_ROWS):
                    block = part.slice(first, BLOCK_ROWS)
                    near = np.frombuffer(b"".join(block.column("pivots").to_pylist()), "<f8").reshape(block.num_rows, -1)
                    own[dim].see(np.asarray(block.column("vec_id")), _matrix(block.column("vec")), near)
        for found in own.values():
            yield found.hits()

    return run


def _blocks(asked: DataFrame, query_bytes: int) -> Iterator[dict[int, tuple]]:
    """The queries in parts of about ``query_bytes``, one query at least; the driver has one part at a time."""
    size = F.sum(F.octet_length("vec") + F.octet_length("pivots") + 64)
    facts = asked.agg(size.alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = min(-(-(facts["bytes"] or 0) // query_bytes), facts["n"])
    for part in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        held: dict[int, list] = {}
        for row in own.collect():
            held.setdefault(row.dim, []).append(row)
        if held:
            yield _arrays(held)


def _arrays(held: dict[int, list]) -> dict[int, tuple]:
    return {
        dim: (
            np.array([r.vec_id for r in rows], dtype=np.int64),
            np.frombuffer(b"".join(bytes(r.vec) for r in rows), "<i8").reshape(len(rows), -1),
            np.frombuffer(b"".join(bytes(r.pivots) for r in rows), "<f8").reshape(len(rows), -1),
        )
        for dim, rows in held.items()
    }


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product for each query.

    ``vectors``: vec_id LONG, vector ARRAY<LONG>; ``is_query`` is a condition on vec_id.  Candidates
    are all rows but those with the query's own id; ties go to the smaller vec_id; a query has fewer
    rows if there are fewer candidates.  Rows with a null id or vector take no part; vectors of
    different lengths have no product.  Repeated rows of other ids than the query's count once each.
    Scores must fit in a LONG; beyond 2**53 they are made in whole numbers.

    One pass over the pivot table serves as many queries as fit in ``query_bytes``; each task keeps k
    rows per query of the pass, and ranks are made of those.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    table = pivot_table(usable.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<bigint>").alias("vector")), pivots)
    spark, out = vectors.sparkSession, None
    own = F.min(F.struct("dim", "vec", "pivots")).alias("own")
    asked = materialize(table.where(is_query).groupBy("vec_id").agg(own).select("vec_id", "own.*"), "queries")
    for block in _blocks(asked, query_bytes):
        hits = table.mapInArrow(_search(spark.sparkContext.broadcast(block), k), HITS)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        ranked = materialize(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = spark.createDataFrame([], HITS + ", rank int")
    return out.select("query_id", "rank", "vec_id", "score")
