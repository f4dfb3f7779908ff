"""Centroid clustering with the threshold algorithm.

Each dimension has the centroids sorted by their component.  From a vector's own value the lists are walked
outward, one entry of every dimension at a step; a centroid that comes up for the first time gets its exact
distance.  What no list has shown yet is in every dimension at least as far as the entry just read, so the
walk ends when the sum of those squared frontier distances is strictly larger than the best exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clanmark.llm.base import col
from clanmark.llm.vectors import by_length, floored, packed, unpacked
from clanmark.sources.workspace import materialize, release

CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Vectors that walk together.
BLOCK_ROWS = 1024
FAR = np.iinfo(np.int64).max


class Lists:
    """The centroids (a row each), and for every dimension their components in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        values = np.take_along_axis(centroids, self.order, 0)
        ends = np.full((1, centroids.shape[1]), FAR)
        self.values = np.concatenate([values, ends])  # an end that is never nearer than an entry
        self.dims = np.arange(centroids.shape[1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; ties go to the smaller number."""
        parts = [self._walk(x[i : i + BLOCK_ROWS]) for i in range(0, len(x), BLOCK_ROWS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dim = self.centroids.shape
        exact = np.full((len(x), k), FAR)
        above = np.empty(x.shape, dtype=np.int64)
        for d in range(dim):
            above[:, d] = np.searchsorted(self.values[:k, d], x[:, d])
        below, open_rows = above - 1, np.arange(len(x))
        for _ in range(k):
            own = x[open_rows]
            gap_below = np.where(below >= 0, own - self.values[below, self.dims], FAR)
            gap_above = np.where(above < k, self.values[above, self.dims] - own, FAR)
            down = gap_below <= gap_above
            shown = self.order[np.where(down, below, np.minimum(above, k - 1)), self.dims]
            below, above = below - down, above + ~down
            new = np.zeros((len(open_rows), k), dtype=bool)
            new[np.arange(len(open_rows))[:, None], shown] = True
            row, number = np.nonzero(new & (exact[open_rows] == FAR))
            gaps = own[row] - self.centroids[number]
            exact[open_rows[row], number] = np.einsum("ij,ij->i", gaps, gaps)
            frontier = (np.minimum(gap_below, gap_above).astype(np.float64) ** 2).sum(1)
            best = exact[open_rows].min(1)
            # the frontier is a sum of rounded squares: a little less of it is surely not too much
            go_on = (frontier * (1 - 1e-12) <= best) & (exact[open_rows] == FAR).any(1)
            open_rows, below, above = open_rows[go_on], below[go_on], above[go_on]
            if not len(open_rows):
                break
        number = exact.argmin(1)
        return number, exact[np.arange(len(x)), number]


def _kept(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, rows in by_length(batch, "vector", differences=True):
                if size == dim:
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), packed(rows)], ["vec_id", "vec"])

    return run


def whole_vectors(df: DataFrame, dim: int = DIM, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the vectors of exactly ``dim`` finite components, as packed whole numbers, written once."""
    own = df.select(col(key).cast("long").alias("vec_id"), floored(vector, scale).alias("vector"))
    return materialize(own.where(F.size("vector") == dim).mapInArrow(_kept(dim), "vec_id long, vec binary"), "vectors")


def first_centroids(table: DataFrame, k: int = CENTROIDS, prefix: str = "2:") -> np.ndarray:
    """The ``k`` vectors (all, if fewer) of least sha256 of prefix and id, in that order.

    Rows of one id follow each other by their bytes; rows without an id start no centroid.
    """
    digest = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = table.where("vec_id IS NOT NULL").select(digest.alias("digest"), "vec").orderBy("digest", "vec").limit(k)
    return unpacked(rows.select("vec").toArrow().column(0))


def _totals(lists):
    """(cluster, dim, total) per task: component sums, and the number of rows as dimension -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.value
        sums = np.zeros((len(own.centroids), 1 + own.centroids.shape[1]), dtype=object)
        for batch in batches:
            x = unpacked(batch.column("vec"))
            for i in range(0, len(x), BLOCK_ROWS):  # 1024 components below 2**31 add up exactly
                part = np.concatenate([np.ones((len(x[i : i + BLOCK_ROWS]), 1), np.int64), x[i : i + BLOCK_ROWS]], 1)
                number, _ = own.nearest(x[i : i + BLOCK_ROWS])
                add = np.zeros(sums.shape, dtype=np.int64)
                np.add.at(add, number, part)
                sums += add
        at, dim = np.nonzero(sums)
        totals = pa.array([str(t) for t in sums[at, dim]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dim - 1), totals], ["cluster", "dim", "total"])

    return run


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of each one's vectors; those without a vector stay.

    The driver gets a row per centroid and dimension; sums are DECIMAL and exact.
    """
    lists = table.sparkSession.sparkContext.broadcast(Lists(centroids))
    parts = table.mapInArrow(_totals(lists), "cluster long, dim long, total string")
    totals = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = np.zeros((len(centroids), 1 + centroids.shape[1]), dtype=object)
    for r in totals.collect():
        sums[r["cluster"], 1 + r["dim"]] = int(r["total"])
    out = centroids.copy()
    for number, (count, *own) in enumerate(sums.tolist()):
        if count:
            out[number] = [total // count for total in own]
    return out


def _assigned(lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = lists.value.nearest(unpacked(batch.column("vec")))
                columns = [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every row."""
    lists = table.sparkSession.sparkContext.broadcast(Lists(centroids))
    return table.mapInArrow(_assigned(lists), "vec_id long, cluster int, distance long")


def clusters(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    ``df`` has vec_id and embedding; vectors of another length than ``dim``, null ones and those with a null or
    non-finite component take no part.  Every row counts, repeated ones and those without an id too; with
    fewer than ``k`` vectors there are fewer centroids, without any no row.  Components beyond 2**27 in whole
    numbers (for 64 dimensions) are clipped so that distances fit in a LONG; inertias beyond a LONG are its largest value.
    """
    spark = df.sparkSession
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    table = whole_vectors(df, dim, scale)
    centroids = first_centroids(table, k)
    if not len(centroids):
        return spark.createDataFrame([], kind)
    for _ in range(rounds):
        centroids = moved(table, centroids)
    placed = materialize(assigned(table, centroids), "assigned")
    release(table)
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    total = min(int(sum(r["own"] for r in sums)), FAR)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    facts = [(r["cluster"], min(int(r["own"]), int(FAR)), int(total), digests[r["cluster"]]) for r in sums]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(*[f.split()[0] for f in kind.split(", ")])
