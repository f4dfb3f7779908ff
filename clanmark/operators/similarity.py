"""Exact cosine joins over vector tables.

Rows are laid over *work units* of bounded size and each unit is one matrix product
inside a task.  Small inputs make a single unit; the size grows with the rows per core,
since larger units mean fewer copies in the shuffle.  Larger ones are partitioned around
pivots sampled from the data: a row lives in the cell (nearest pivot, angle ring) and
also visits the cells that can hold a partner.  Two bounds decide that, both exact on
the unit sphere where the angle is a metric:

* triangle inequality: a cell with angles [low, high] around pivot p can only hold
  partners of x if  low - theta <= angle(x, p) <= high + theta;
* bisector: rows of cell p are at least as close to p as to q, so x is at least
  arcsin((x.q - x.p) / |q - p|) away from all of them.

Every pair is compared in one place only.  A cell with more rows than a unit may hold
is cut into chunks, and its chunk pairs become separate units, so a cell with a third
of all rows spreads over many tasks and nothing is capped or dropped.  A table whose rows
would visit most cells has no pivots: its chunks meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.functions.vectors import dimension_of, of_length
from clanmark.sources.workspace import materialize, release

MIN_UNIT_ROWS = 2048
MAX_UNIT_ROWS = 32768
MAX_PIVOTS = 2048
#: A table cut into more units than so many makes copies of rows and not work for more tasks, while units may still grow.
MOST_CHUNKS = 32
SAMPLED_VISITORS = 1024
#: Rows of one side of a unit, where all rows of a table meet in chunks, take so many bytes at most.
CHUNK_BYTES = 32 * 1024 * 1024
#: A pivot with more than so many units of rows gets pivots of its own, so many at most, all of them together in so many bytes.
FEW_UNITS = 4
MAX_CHILDREN = 1024
PIVOT_BYTES = 64 * 1024 * 1024
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_QUERIES = 1024
SLACK = 1e-9  # of similarities
ANGLE_SLACK = 1e-6  # arccos loses half of the digits near 1
SCRATCH_ELEMENTS = 4_000_000


# ---------------------------------------------------------------- arrays in tasks


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length matrix of the usable rows, and their positions in the input.

    Null, empty, zero and non-finite vectors have no direction and are left out.  The
    operators have replaced vectors of an unusual length by null (``_one_length``).
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    dim = int(lengths.max(initial=0))
    if dim == 0:
        return np.empty((0, 0)), np.empty(0, dtype=np.int64)
    keep = np.flatnonzero(lengths == dim)
    if np.any((lengths != dim) & (lengths > 0)):
        raise ValueError("vectors of different lengths in one table")
    flat = vectors.take(pa.array(keep)).flatten().cast(pa.float64())
    matrix = flat.to_numpy(zero_copy_only=False).reshape(len(keep), dim)
    with np.errstate(all="ignore"):
        norms = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(norms) & (norms > 0)
    return matrix[good] / norms[good, None], keep[good]


def list_array(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(0, (rows + 1) * dim, dim) if dim else [0] * (rows + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number repeated ``counts`` times, and 0..count-1 within each row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return rows, np.arange(len(rows)) - starts


# ---------------------------------------------------------------- layout


@dataclass(frozen=True)
class Layout:
    """Where rows live and which cells they visit.  Bounded by pivots x rings."""

    threshold: float
    pivots: np.ndarray | None = None
    pivot_ids: tuple = ()
    home_rows: np.ndarray | None = None
    visit_rows: np.ndarray | None = None
    unit_rows: int = MIN_UNIT_ROWS
    home_chunk_rows: int = MIN_UNIT_ROWS
    visit_chunk_rows: int = MIN_UNIT_ROWS
    groups: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    forest: bool = False
    own_pivot_only: bool = False
    parents: np.ndarray | None = None
    first: np.ndarray | None = None

    @cached_property
    def ring_edges(self) -> np.ndarray:
        """Two rings up to theta (the core: rows within the threshold), then wider ones."""
        end = [math.pi + ANGLE_SLACK]
        if self.threshold <= 0:
            return np.concatenate([np.arange(0, math.pi, 0.2), end])
        theta = math.acos(min(1.0, self.threshold))
        return np.concatenate([[0.0, theta / 2], np.arange(theta, math.pi, max(theta / 2, 0.2)), end])

    @cached_property
    def gaps(self) -> np.ndarray:
        """Distance of every two pivots of the upper level."""
        return _gaps(self.pivots if self.parents is None else self.parents)

    @cached_property
    def widest(self) -> int:
        """Pivots that a row is compared with at a time, at most."""
        return len(self.pivots) if self.parents is None else max(len(self.parents), int(np.diff(self.first).max()))

    @property
    def rings(self) -> int:
        return 1 if self.pivots is None else len(self.ring_edges) - 1

    @property
    def cells(self) -> int:
        return self.rings * (1 if self.pivots is None else len(self.pivots))

    def home_chunks(self) -> np.ndarray:
        return np.ceil(self.home_rows / self.home_chunk_rows).astype(np.int64)

    def visit_chunks(self) -> np.ndarray:
        return np.ceil(self.visit_rows / self.visit_chunk_rows).astype(np.int64)

    def is_core(self, sims: np.ndarray) -> np.ndarray:
        return np.round(sims, 12) >= self.threshold

    def near(self, matrix: np.ndarray, bounds: np.ndarray | None = None, visits: bool = True) -> Near:
        """Home cell of every row, and the pivots whose cells may hold a partner by the bisector bounds.

        A pivot of the upper level with many rows has pivots of its own: its rows live with the nearest of
        those, and only rows that reach the upper pivot's rows are compared with them.
        """
        n = len(matrix)
        if self.pivots is None:
            none = np.zeros(0, np.int64)
            return Near(np.zeros(n, dtype=np.int64), np.ones(n), none, none, np.zeros(0))
        bound = np.full(n, self.threshold) if bounds is None else np.maximum(bounds, self.threshold)
        theta = _angles(bound)
        reach = np.where(theta < math.pi / 2, np.sin(theta), 1.0)
        wanted = visits and not self.own_pivot_only
        sims = matrix @ (self.pivots if self.parents is None else self.parents).T
        nearest = sims.argmax(axis=1)
        best = sims[np.arange(n), nearest]
        if wanted:
            rows, pivots = np.nonzero(best[:, None] - sims <= self.gaps[nearest] * reach[:, None] + SLACK)
        else:
            rows, pivots = np.arange(n), nearest
        near = sims[rows, pivots]
        if self.parents is not None:
            nearest, best, rows, pivots, near = self._below(matrix, nearest, rows, pivots, reach, wanted)
        ring = np.searchsorted(self.ring_edges, _angles(best), "right") - 1
        if self.threshold > 0:
            # rings 0 and 1 hold exactly the rows within the threshold of their pivot
            ring = np.where(self.is_core(best), np.minimum(ring, 1), np.maximum(ring, 2))
        return Near(nearest * self.rings + self.group(nearest, ring), best, rows, pivots, near)

    def _below(self, matrix, nearest, rows, parents, reach, wanted):
        """The same one level down, an upper pivot at a time; siblings bound each other's rows."""
        home, best, found = np.empty(len(matrix), np.int64), np.empty(len(matrix)), []
        order = np.argsort(parents, kind="stable")
        rows, parents = rows[order], parents[order]
        for parent in np.unique(parents):
            own = rows[np.searchsorted(parents, parent) : np.searchsorted(parents, parent, "right")]
            begin, end = self.first[parent], self.first[parent + 1]
            sims = matrix[own] @ self.pivots[begin:end].T
            top, place = sims.argmax(axis=1), np.arange(len(own))
            at_home = nearest[own] == parent
            home[own[at_home]], best[own[at_home]] = begin + top[at_home], sims[place, top][at_home]
            if wanted:
                margin = sims[place, top][:, None] - sims
                i, j = np.nonzero(margin <= _gaps(self.pivots[begin:end])[top] * reach[own][:, None] + SLACK)
                found.append((own[i], begin + j, sims[i, j]))
        if not wanted:
            return home, best, np.arange(len(matrix)), home, best
        return home, best, *_joined(found)

    def group(self, pivots: np.ndarray, rings: np.ndarray) -> np.ndarray:
        """Neighbouring rings of one pivot with few rows share a cell."""
        return rings if self.groups is None else self.groups[pivots, rings]

    def only_core(self, cells: np.ndarray) -> np.ndarray:
        """Whether a cell holds the core of its pivot and nothing else."""
        return (cells % self.rings == 0) & (self.groups[cells // self.rings, 2] == 1)

    def with_rows(self, ring_rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Layout:
        """Rows and angles per ring are known: rings join until a cell is worth a unit.

        Only a large core becomes a cell of its own, whose rows need no comparison.
        """
        shape = (len(self.pivots), self.rings)
        rows, groups = ring_rows.reshape(shape), np.zeros(shape, dtype=np.int64)
        home_rows = np.zeros_like(rows)
        for p in range(len(rows)):
            group = 0
            for ring in range(self.rings):
                if ring >= 2 and home_rows[p, group] * 2 >= self.unit_rows:
                    group += 1
                groups[p, ring] = group
                home_rows[p, group] += rows[p, ring]
        cell = (np.arange(shape[0])[:, None] * self.rings + groups).ravel()
        cell_low, cell_high = np.full(self.cells, np.inf), np.full(self.cells, -np.inf)
        np.minimum.at(cell_low, cell, low)
        np.maximum.at(cell_high, cell, high)
        return replace(self, groups=groups, home_rows=home_rows.ravel(), low=cell_low, high=cell_high)

    @cached_property
    def tightness(self) -> np.ndarray:
        """Rank of the cells by radius: rows of a wide cell visit the tight one."""
        rank = np.empty(self.cells, dtype=np.int64)
        rank[np.argsort(self.high, kind="stable")] = np.arange(self.cells)
        return rank

    def visits(self, near: Near, one_table: bool, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit; each pair of one table meets exactly once.

        ``bounds`` raises the similarity that a partner of a row must have.
        """
        bound = np.full(len(near.homes), self.threshold) if bounds is None else np.maximum(bounds, self.threshold)
        rows, pivots, sim = near.rows, near.pivots, near.sims
        angle, width = _angles(sim), _angles(bound)[rows] + ANGLE_SLACK
        tied = self.is_core(sim) if self.forest else None
        found = []
        for group in range(int(self.groups.max()) + 1):
            cells = pivots * self.rings + group
            keep = (angle <= self.high[cells] + width) & (angle >= self.low[cells] - width)
            if one_table:
                own = near.homes[rows]
                keep &= self.tightness[cells] < self.tightness[own]
            if self.forest:
                # a row within the threshold of a pivot is tied to it, so its core is reached
                keep &= ~(tied & self.only_core(cells))
            found.append((rows[keep], cells[keep]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass(frozen=True)
class Near:
    """Home cell and home similarity per row; (row, pivot, similarity) of the pivots a row may visit."""

    homes: np.ndarray
    best: np.ndarray
    rows: np.ndarray
    pivots: np.ndarray
    sims: np.ndarray


def _gaps(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))


def _angles(sims: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sims, -1, 1))


def _sample_pivots(df: DataFrame, key: str, vector: str, rows: int, count: int) -> tuple:
    """At most ``count`` pivots, well apart from each other, from a bounded sample."""
    wanted = 4 * count
    sample = df.select(key, vector).sample(min(1.0, 1.5 * wanted / max(rows, 1)), seed=7)
    table = sample.limit(2 * wanted).toArrow()
    matrix, kept = unit_rows(table.column(vector))
    ids = table.column(key).take(pa.array(kept)).to_pylist()
    chosen = _apart(matrix, count)
    return matrix[chosen], tuple(ids[i] for i in chosen)


def _apart(matrix: np.ndarray, count: int) -> list[int]:
    """The first ``count`` rows that are well apart from those before."""
    chosen: list[int] = []
    for i in range(len(matrix)):
        if len(chosen) == count:
            break
        # near copies share one pivot, so a tight hot group stays in one core cell
        if not chosen or (matrix[chosen] @ matrix[i]).max() < 0.95:
            chosen.append(i)
    return chosen


def _ring_stats(df: DataFrame, vector: str, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, lowest and highest angle per ring of every pivot."""
    shared = df.sparkSession.sparkContext.broadcast(layout)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        rows = np.zeros(plan.cells, dtype=np.int64)
        low, high = np.full(plan.cells, np.inf), np.full(plan.cells, -np.inf)
        for batch in batches:
            matrix, _ = unit_rows(batch.column(0))
            for span in _slices(len(matrix), plan):
                near = plan.near(matrix[span], visits=False)
                rings, angle = near.homes, _angles(near.best)
                rows += np.bincount(rings, minlength=plan.cells)
                np.minimum.at(low, rings, angle)
                np.maximum.at(high, rings, angle)
        used = np.flatnonzero(rows)
        columns = [pa.array(used), pa.array(rows[used]), pa.array(low[used]), pa.array(high[used])]
        yield pa.RecordBatch.from_arrays(columns, ["ring", "n", "low", "high"])

    measured = df.select(vector).mapInArrow(measure, "ring long, n long, low double, high double")
    rows = np.zeros(layout.cells, dtype=np.int64)
    low, high = np.full(layout.cells, np.inf), np.full(layout.cells, -np.inf)
    for row in measured.groupBy("ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        rows[row["ring"]], low[row["ring"]], high[row["ring"]] = row["n"], row["low"], row["high"]
    return rows, low, high


def _visit_counts(
    df: DataFrame, vector: str, layout: Layout, one_table: bool, bound: str | None = None
) -> np.ndarray:
    """Visits per cell."""
    shared = df.sparkSession.sparkContext.broadcast(layout)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        totals = np.zeros(plan.cells, dtype=np.int64)
        for batch in batches:
            matrix, kept = unit_rows(batch.column(0))
            bounds = np.asarray(batch.column(1))[kept] if bound else None
            for span in _slices(len(matrix), plan):
                own = bounds[span] if bound else None
                cells = plan.visits(plan.near(matrix[span], own), one_table, own)[1]
                totals += np.bincount(cells, minlength=plan.cells)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["cell", "n"])

    counted = df.select(vector, *([bound] if bound else [])).mapInArrow(count, "cell long, n long")
    result = np.zeros(layout.cells, dtype=np.int64)
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        result[row["cell"]] = row["n"]
    return result


def _slices(rows: int, layout: Layout) -> Iterator[slice]:
    step = rows if layout.pivots is None else SCRATCH_ELEMENTS // layout.widest
    for start in range(0, rows, max(step, 1)):
        yield slice(start, start + max(step, 1))


def _finer(df: DataFrame, key: str, vector: str, layout: Layout) -> Layout | None:
    """The layout with pivots of their own below those of many rows; None if there are none.

    A pivot of more than ``FEW_UNITS`` units gets two for each unit, from a sample of its rows: a group of
    rows without a pivot near it makes its cell wide, and a wide cell is visited by many.  All
    pivots together take ``PIVOT_BYTES`` at most, with what is sampled twice that in the driver.
    """
    count, dim = layout.pivots.shape
    rows = layout.home_rows.reshape(count, -1).sum(axis=1)
    wanted = np.where(rows > FEW_UNITS * layout.unit_rows, np.minimum(2 * rows // layout.unit_rows, MAX_CHILDREN), 0)
    room = max(0, PIVOT_BYTES // (8 * dim) - count)
    if wanted.sum() > room:
        wanted = wanted * room // wanted.sum()
    wanted[wanted < 2] = 0
    if not wanted.any():
        return None
    shares = np.minimum(2.0 * wanted / np.maximum(rows, 1), 1.0)
    shared = df.sparkSession.sparkContext.broadcast((layout, shares))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, part = shared.value
        for batch in batches:
            matrix, kept = unit_rows(batch.column(1))
            chance = np.asarray(batch.column(2))[kept] / float(1 << 40)
            for span in _slices(len(matrix), plan):
                own = plan.near(matrix[span], visits=False).homes // plan.rings
                some = np.flatnonzero(chance[span] < part[own])
                ids = batch.column(0).take(pa.array(kept[some + span.start]))
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), ids, list_array(matrix[span][some])], ["pivot", "id", "unit"])

    kind = T.StructType([T.StructField("pivot", T.LongType()), T.StructField("id", df.schema[key].dataType), T.StructField("unit", T.ArrayType(T.DoubleType()))])
    chance = F.pmod(F.xxhash64(F.lit("pivots"), key), F.lit(1 << 40))
    found = df.select(key, vector, chance.alias("_h")).mapInArrow(sample, kind).toArrow().combine_chunks()
    own = np.asarray(found.column("pivot"))
    vectors = np.asarray(found.column("unit").combine_chunks().flatten()).reshape(-1, dim)
    pivots, ids, first = [], [], [0]
    for pivot in range(count):
        at = np.flatnonzero(own == pivot) if wanted[pivot] else own[:0]
        chosen = _apart(vectors[at], int(wanted[pivot]))
        if len(chosen) > 1:
            pivots.append(vectors[at[chosen]])
            ids += found.column("id").take(pa.array(at[chosen])).to_pylist()
        else:
            pivots.append(layout.pivots[pivot : pivot + 1])
            ids.append(layout.pivot_ids[pivot])
        first.append(len(ids))
    if len(ids) == count:
        return None
    return Layout(
        layout.threshold, np.concatenate(pivots), tuple(ids), unit_rows=layout.unit_rows,
        home_chunk_rows=layout.home_chunk_rows, forest=layout.forest, parents=layout.pivots, first=np.array(first),
    )


def _tells_apart(df: DataFrame, vector: str, layout: Layout, rows: int) -> bool:
    """Whether a row visits no more cells than the table has chunks; a few sampled rows say so.

    Many pivots pay where they tell groups apart.  Where they do not, nearly every row visits every cell, and
    copies per row are the number of cells.  The sample only steers the placement.
    """
    count = -(-rows // layout.home_chunk_rows)
    if len(layout.pivots) <= 2 * max(2, count):
        return True
    return _sampled_visits(df, vector, layout, rows) <= count


def _sampled_visits(df: DataFrame, vector: str, layout: Layout, rows: int) -> float:
    """Cells that a row of one table visits besides its own, by a few sampled rows."""
    wanted = max(64, min(SAMPLED_VISITORS, 2 * SCRATCH_ELEMENTS // len(layout.pivots)))
    visitors = materialize(df.select(vector).sample(min(1.0, wanted / max(rows, 1)), seed=7), "visitors")
    visits = int(_visit_counts(visitors, vector, layout, True).sum()) / max(visitors.count(), 1)
    release(visitors)
    return visits


def _chunked(df: DataFrame, layout: Layout, rows: int) -> Layout:
    """The layout without pivots, whose every two chunks are a unit: two units or more per core, and a row in each
    of a number of chunks that does not grow with the table until chunks have ``CHUNK_BYTES``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    chunks = math.ceil((math.sqrt(1 + 16 * cores) - 1) / 2)
    most = max(MIN_UNIT_ROWS, CHUNK_BYTES // (8 * layout.pivots.shape[1]))
    chunk_rows = min(max(MIN_UNIT_ROWS, -(-rows // chunks)), most)
    return Layout(layout.threshold, unit_rows=chunk_rows, home_chunk_rows=chunk_rows, forest=layout.forest, home_rows=np.array([rows]))


def _coarser(layout: Layout, rows: int) -> Layout:
    """The layout with a pivot per chunk of the table."""
    count = max(2, -(-rows // layout.home_chunk_rows))
    kept = np.linspace(0, len(layout.pivots) - 1, count).astype(np.int64)
    return Layout(
        layout.threshold, layout.pivots[kept], tuple(layout.pivot_ids[i] for i in kept),
        unit_rows=layout.home_chunk_rows, home_chunk_rows=layout.home_chunk_rows, forest=layout.forest,
    )


def _place(
    homes: DataFrame, key: str, vector: str, threshold: float, unit_rows_limit: int | None, pivots: int | None, forest: bool,
    more: tuple[str, ...] = (), one_table: bool = False,
) -> tuple[DataFrame, Layout]:
    """The home table and its layout: pivots from a sample, rows per cell from one pass.

    Where the rows of one table would visit more cells than it has chunks, there are no pivots but chunks.
    All driver state is bounded by pivots x rings.  The table is written once, with the columns in
    use, and read for its size, its pivots and its cells.
    """
    homes = materialize(homes.select(key, vector, *more), "vectors")
    rows = homes.count()
    free = one_table and unit_rows_limit is None and pivots is None
    if unit_rows_limit is None:
        share = rows // (2 * homes.sparkSession.sparkContext.defaultParallelism)
        unit_rows_limit = min(max(share, MIN_UNIT_ROWS), MAX_UNIT_ROWS)
    chunk_rows = _grown(unit_rows_limit, rows)
    layout = Layout(threshold, unit_rows=unit_rows_limit, home_chunk_rows=chunk_rows, forest=forest)
    count = min(rows // unit_rows_limit, MAX_PIVOTS) if pivots is None else pivots
    if count > 1:
        matrix, ids = _sample_pivots(homes, key, vector, rows, count)
        if len(matrix) > 1:
            layout = replace(layout, pivots=matrix, pivot_ids=ids)
            stats = _ring_stats(homes, vector, layout)
            layout = layout.with_rows(*stats)
            if free:
                plain = _chunked(homes, layout, rows)
                if _sampled_visits(homes, vector, layout, rows) + 1 > plain.home_chunks()[0]:
                    return homes, plain
            if not _tells_apart(homes, vector, layout, rows):
                layout = _coarser(layout, rows)
                return homes, layout.with_rows(*_ring_stats(homes, vector, layout))
            finer = _finer(homes, key, vector, layout)
            if finer is not None:
                finer = finer.with_rows(*_ring_stats(homes, vector, finer))
                if not _tells_apart(homes, vector, finer, rows):
                    return homes, replace(layout, unit_rows=chunk_rows).with_rows(*stats)
            return homes, layout if finer is None else finer
    return homes, replace(layout, home_rows=np.array([rows]))


def _visited(
    visitors: DataFrame, vector: str, layout: Layout, one_table: bool, bound: str | None = None
) -> Layout:
    """The layout with the number of visits per cell."""
    if layout.pivots is None:
        rows = np.array([0 if one_table else visitors.count()])
    else:
        rows = _visit_counts(visitors, vector, layout, one_table, bound)
    return replace(layout, visit_rows=rows, visit_chunk_rows=_grown(layout.home_chunk_rows, int(rows.sum())))


def _grown(limit: int, rows: int) -> int:
    """Rows of a chunk: ``limit``, or more where ``rows`` would make over ``MOST_CHUNKS`` of them.

    With chunks of a fixed size every row meets a number of them that grows with the table, and copies with its square.
    """
    return max(limit, min(-(-rows // MOST_CHUNKS), MAX_UNIT_ROWS))


def _one_length(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """``df`` with vectors of any other length than ``dim`` as NULL: they have no direction."""
    return df.withColumn(vector, of_length(vector, dim))


def _one_table(
    df: DataFrame, key: str, vector: str, threshold: float, forest: bool = False,
    unit_rows_limit: int | None = None, pivots: int | None = None, dim: int | None = None,
) -> tuple[DataFrame, Layout, DataFrame]:
    """(table, layout, rows spread over the units) of a self-join; ``dim`` saves a look at all lengths."""
    df = _one_length(df, vector, dimension_of(df, vector) if dim is None else dim)
    df, layout = _place(df, key, vector, threshold, unit_rows_limit, pivots, forest, one_table=True)
    layout = _visited(df, vector, layout, True)
    return df, layout, _spread(df, key, vector, layout, as_home=True, one_table=True)


# ---------------------------------------------------------------- spreading rows over units


def _spread(
    df: DataFrame,
    key: str,
    vector: str,
    layout: Layout,
    as_home: bool,
    one_table: bool,
    bound: str | None = None,
    length: str | None = None,
    term: str | None = None,
    salt: str | None = None,
) -> DataFrame:
    """One row per (row, work unit it takes part in), with its unit vector.

    ``bound`` names a column with the similarity a partner must reach, ``length`` one
    with the length that the vector is shipped with instead of 1, ``term`` one that is shipped as
    one more component, ``salt`` the column that spreads rows over chunks if ``key`` is not unique.
    """
    spark = df.sparkSession
    more = [c for c in (bound, length, term) if c]
    shared = spark.sparkContext.broadcast(layout)
    names = ["cell", "left", "right", "side", "id", "unit"]
    schema = T.StructType(
        [
            T.StructField("cell", T.LongType()),
            T.StructField("left", T.LongType()),
            T.StructField("right", T.LongType()),
            T.StructField("side", T.LongType()),
            T.StructField("id", df.schema[key].dataType),
            T.StructField("unit", T.ArrayType(T.DoubleType())),
        ]
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        home_chunks, visit_chunks = plan.home_chunks(), plan.visit_chunks()
        for batch in batches:
            matrix, kept = unit_rows(batch.column(1))
            ids = batch.column(0).take(pa.array(kept))
            salt = np.asarray(batch.column(2))[kept]
            bounds, lengths, terms = (
                np.asarray(batch.column(3 + more.index(c)))[kept] if c else None for c in (bound, length, term)
            )
            for span in _slices(len(matrix), plan):
                part = matrix[span]
                own = bounds[span] if bound else None
                visiting = not as_home or (one_table and plan.pivots is not None)
                near = plan.near(part, own, visiting)
                homes, blocks = near.homes, []
                if as_home:
                    blocks += _home_units(plan, homes, salt[span], home_chunks, visit_chunks, one_table)
                if visiting:
                    if plan.pivots is None:
                        rows, cells = np.arange(len(part)), homes
                    else:
                        rows, cells = plan.visits(near, one_table, own)
                    blocks.append(_visit_units(rows, cells, salt[span], home_chunks, visit_chunks))
                if length:
                    part = part * lengths[span][:, None]
                if term:
                    part = np.column_stack([part, terms[span]])
                for rows, cell, left, right, side in blocks:
                    for start in range(0, len(rows), 8192):
                        cut = slice(start, start + 8192)
                        picked = rows[cut]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(cell[cut]),
                                pa.array(left[cut]),
                                pa.array(right[cut]),
                                pa.array(side[cut]),
                                ids.take(pa.array(picked + span.start)),
                                list_array(part[picked]),
                            ],
                            names,
                        )

    salted = F.pmod(F.xxhash64(salt or key), F.lit(1 << 40)).alias("_h")
    hashed = df.select(key, vector, salted, *more)
    return hashed.mapInArrow(spread, schema)


def _home_units(plan, homes, salt, home_chunks, visit_chunks, one_table):
    chunk = salt % np.maximum(home_chunks[homes], 1)
    blocks = []
    if one_table:
        copies = home_chunks[homes].copy()
        if plan.forest and plan.pivots is not None:
            copies[plan.only_core(homes)] = 0  # core rows are already tied to their pivot
        rows, other = _expand(copies)
        own = chunk[rows]
        left, right = np.minimum(own, other), np.maximum(own, other)
        blocks.append((rows, homes[rows], left, right, (own > other).astype(np.int64)))
    rows, other = _expand(visit_chunks[homes])
    ones = np.ones(len(rows), dtype=np.int64)
    blocks.append((rows, homes[rows], -1 - other, chunk[rows], ones))
    return blocks


def _visit_units(rows, cells, salt, home_chunks, visit_chunks):
    chunk = salt[rows] % np.maximum(visit_chunks[cells], 1)
    picked, other = _expand(home_chunks[cells])
    zeros = np.zeros(len(picked), dtype=np.int64)
    return rows[picked], cells[picked], -1 - chunk[picked], other, zeros


# ---------------------------------------------------------------- unit kernels


def _sides(table: pa.Table):
    side = np.asarray(table.column("side").combine_chunks())
    ids = table.column("id").combine_chunks()
    matrix = table.column("unit").combine_chunks()
    values = np.asarray(matrix.flatten()).reshape(len(side), -1)
    own = table.num_rows and table.column("left")[0].as_py() == table.column("right")[0].as_py()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if own:
        right = left
    return ids, values[left], values[right], left, right, bool(own)


def _hits(left, right, own: bool, threshold: float, strict: bool, exact: bool = True):
    """(left row, right row, similarity) of the pairs over the threshold.

    Single precision finds the candidates; what lies within its error of the threshold,
    or everything if the values are wanted (``exact``), is decided in double precision.
    """
    margin = max(1e-4, left.shape[1] * 1.2e-7)
    single = right.astype(np.float32).T
    step = max(1, SCRATCH_ELEMENTS // max(len(right), 1))
    for start in range(0, len(left), step):
        rough = left[start : start + step].astype(np.float32) @ single
        if own:
            rough[np.arange(len(right))[None, :] <= start + np.arange(len(rough))[:, None]] = -2
        i, j = np.nonzero(rough >= threshold - margin)
        found = rough[i, j].astype(np.float64)
        i += start
        check = np.arange(len(i)) if exact else np.flatnonzero(found < threshold + margin)
        for cut in range(0, len(check), 100_000):
            part = check[cut : cut + 100_000]
            found[part] = np.round(np.einsum("ij,ij->i", left[i[part]], right[j[part]]), 12)
        ok = found > threshold if strict else found >= threshold
        yield i[ok], j[ok], found[ok]


Kernel = Callable[[pa.Table], pa.Table]


def _pairs_kernel(threshold: float, strict: bool, ordered: bool) -> Kernel:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the hits of one slice at a time: a unit of near copies has very many
        ids, l_matrix, r_matrix, left, right, own = _sides(pa.Table.from_batches(batches))
        for i, j, sims in _hits(l_matrix, r_matrix, own, threshold, strict):
            a, b = ids.take(pa.array(left[i])), ids.take(pa.array(right[j]))
            if ordered:
                swap = pc.greater(a, b)
                a, b = pc.if_else(swap, b, a), pc.if_else(swap, a, b)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sims)], names=["a", "b", "similarity"])

    return kernel


def _degree_kernel(threshold: float, strict: bool) -> Kernel:
    def kernel(table: pa.Table) -> pa.Table:
        ids, l_matrix, r_matrix, left, right, own = _sides(table)
        counts = np.zeros(len(ids), dtype=np.int64)
        for i, j, _ in _hits(l_matrix, r_matrix, own, threshold, strict, exact=False):
            counts += np.bincount(left[i], minlength=len(ids)) + np.bincount(right[j], minlength=len(ids))
        used = np.flatnonzero(counts)
        return pa.table([ids.take(pa.array(used)), pa.array(counts[used])], names=["id", "n"])

    return kernel


def _forest_kernel(threshold: float) -> Kernel:
    """A spanning forest of the hits, skipping what is already known to be connected.

    The rows of the largest set so far are only compared with rows outside of it, so a
    dense unit is done after its first slice.
    """

    def kernel(table: pa.Table) -> pa.Table:
        ids, l_matrix, r_matrix, left, right, own = _sides(table)
        labels = np.arange(len(ids))
        step = max(256, SCRATCH_ELEMENTS // max(len(right), 1))
        for start in range(0, len(left), step):
            rows = np.arange(start, min(start + step, len(left)))
            others = np.arange(start if own else 0, len(right))
            largest = np.bincount(labels).argmax()
            inside = labels[left[rows]] == largest
            outside = others[labels[right[others]] != largest]
            for some, against in ((rows[~inside], others), (rows[inside], outside)):
                if not len(some) or not len(against):
                    continue
                for i, j, _ in _hits(l_matrix[some], r_matrix[against], False, threshold, False, exact=False):
                    labels = merge_labels(labels, left[some[i]], right[against[j]])
        child = np.flatnonzero(labels != np.arange(len(ids)))
        a, b = ids.take(pa.array(child)), ids.take(pa.array(labels[child]))
        return pa.table([a, b], names=["a", "b"])

    return kernel


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a[k]`` and ``b[k]``; a label is the lowest position of its set."""
    labels = labels.copy()
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_edges = low != high
        if not open_edges.any():
            return labels
        a, b, low, high = a[open_edges], b[open_edges], low[open_edges], high[open_edges]
        np.minimum.at(labels, high, low)
        while True:
            shorter = labels[labels]
            if np.array_equal(shorter, labels):
                break
            labels = shorter


def best_of(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the largest product per left row; the first one wins ties."""
    best = np.empty(len(left), dtype=np.int64)
    sims = np.empty(len(left))
    step = max(1, SCRATCH_ELEMENTS // max(len(right), 1))
    for start in range(0, len(left), step):
        block = np.round(left[start : start + step] @ right.T, 12)
        best[start : start + step] = block.argmax(axis=1)
        sims[start : start + step] = block.max(axis=1)
    return best, sims


def _run_units(spread: DataFrame, kernel: Kernel, schema: T.StructType) -> DataFrame:
    return spread.groupBy("cell", "left", "right").applyInArrow(kernel, schema)


# ---------------------------------------------------------------- operators


def _check_threshold(threshold: float) -> None:
    if not -1 <= threshold <= 1:
        raise ValueError("the similarity threshold must be in [-1, 1]")


def _pair_schema(a: T.DataType, b: T.DataType, names: tuple[str, str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(names[0], a),
            T.StructField(names[1], b),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def similarity_self_join(
    df: DataFrame,
    key: str,
    vector: str,
    threshold: float = 0.75,
    strict: bool = False,
    **layout_options,
) -> DataFrame:
    """All pairs (a, b, similarity) with a < b and cosine >= ``threshold`` (> if strict)."""
    _check_threshold(threshold)
    _, _, spread = _one_table(df, key, vector, threshold, **layout_options)
    kind = df.schema[key].dataType
    return _run_units(
        spread, _pairs_kernel(threshold, strict, ordered=True), _pair_schema(kind, kind, ("a", "b"))
    )


def neighbour_counts(
    df: DataFrame, key: str, vector: str, threshold: float, strict: bool = False, **layout_options
) -> DataFrame:
    """(id, n): other rows within the threshold, without writing out the pairs."""
    _check_threshold(threshold)
    _, _, spread = _one_table(df, key, vector, threshold, **layout_options)
    schema = T.StructType(
        [T.StructField("id", df.schema[key].dataType), T.StructField("n", T.LongType())]
    )
    counted = _run_units(spread, _degree_kernel(threshold, strict), schema)
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def similarity_forest(
    df: DataFrame, key: str, vector: str, threshold: float, **layout_options
) -> DataFrame:
    """Edges (a, b) that connect exactly what the similarity graph connects.

    Every unit returns a spanning forest of its hits, so the output grows with rows and
    not with pairs.  Rows within the threshold of their pivot are tied to it by one edge
    and are not compared with each other: a group of near copies costs one edge per row.
    """
    _check_threshold(threshold)
    df, layout, spread = _one_table(df, key, vector, threshold, forest=True, **layout_options)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    edges = _run_units(spread, _forest_kernel(threshold), schema)
    if layout.pivots is None:
        return edges
    shared = df.sparkSession.sparkContext.broadcast(layout)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        none = np.arange(len(plan.pivots))
        for batch in batches:
            matrix, kept = unit_rows(batch.column(1))
            ids = batch.column(0).take(pa.array(kept))
            centres = pa.array(list(plan.pivot_ids), ids.type)
            together = none
            for span in _slices(len(matrix), plan):
                near = plan.near(matrix[span])
                core = plan.is_core(near.sims)
                tie, other = near.rows[core], near.pivots[core]
                rows, at = np.unique(tie, return_index=True)
                nearest = np.zeros(len(near.homes), dtype=np.int64)
                nearest[rows] = other[at]
                together = merge_labels(together, nearest[tie], other)
                a, b = ids.take(pa.array(rows + span.start)), centres.take(pa.array(nearest[rows]))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])
            child = np.flatnonzero(together != none)
            a, b = centres.take(pa.array(child)), centres.take(pa.array(together[child]))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    tied = df.select(key, vector).mapInArrow(stars, schema)
    return edges.unionByName(tied.where("a <> b"))


def similarity_cross_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    left_vector: str,
    right_key: str,
    right_vector: str,
    threshold: float,
    strict: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    unit_rows_limit: int | None = None,
    pivots: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """All (a, b, similarity) of two tables with cosine over the threshold.

    A right table under ``broadcast_bytes`` is broadcast after its size was checked;
    beyond that the left rows visit the cells of the right table that can hold a partner.
    """
    _check_threshold(threshold)
    schema = _pair_schema(
        left.schema[left_key].dataType, right.schema[right_key].dataType, ("a", "b")
    )
    dim = dimension_of(right, right_vector) if dim is None else dim
    left, right = _one_length(left, left_vector, dim), _one_length(right, right_vector, dim)
    if _fits_broadcast(right, right_key, right_vector, broadcast_bytes):

        def pick(l_matrix: np.ndarray, r_matrix: np.ndarray):
            return _hits(l_matrix, r_matrix, False, threshold, strict)

        return _by_broadcast(left, right, left_key, left_vector, right_key, right_vector, pick, schema)
    right, layout = _place(right, right_key, right_vector, threshold, unit_rows_limit, pivots, False)
    layout = _visited(left, left_vector, layout, False)
    spread = _two_tables(left, right, left_key, left_vector, right_key, right_vector, layout)
    return _run_units(spread, _cross_pairs_kernel(threshold, strict), schema)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0)
    i, j, sims = (np.concatenate(column) for column in zip(*parts))
    return i, j, sims


def _two_tables(left, right, left_key, left_vector, right_key, right_vector, layout, bound=None):
    visiting = _spread(left, left_key, left_vector, layout, False, False, bound)
    at_home = _spread(right, right_key, right_vector, layout, True, False)
    return _common_ids((visiting, at_home))


def _common_ids(sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Both sides in one table, with one id column per side."""
    visiting, at_home = sides
    left_type, right_type = visiting.schema["id"].dataType, at_home.schema["id"].dataType
    rest = ["cell", "left", "right", "side", "unit"]
    a = visiting.select(*rest, F.col("id").alias("l_id"), F.lit(None).cast(right_type).alias("r_id"))
    b = at_home.select(*rest, F.lit(None).cast(left_type).alias("l_id"), F.col("id").alias("r_id"))
    return a.unionByName(b)


def _cross_sides(table: pa.Table):
    side = np.asarray(table.column("side").combine_chunks())
    values = np.asarray(table.column("unit").combine_chunks().flatten()).reshape(len(side), -1)
    return (
        table.column("l_id").combine_chunks(),
        table.column("r_id").combine_chunks(),
        values,
        np.flatnonzero(side == 0),
        np.flatnonzero(side == 1),
    )


def _cross_pairs_kernel(threshold: float, strict: bool) -> Kernel:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        l_ids, r_ids, values, left, right = _cross_sides(pa.Table.from_batches(batches))
        for i, j, sims in _hits(values[left], values[right], False, threshold, strict):
            columns = [l_ids.take(pa.array(left[i])), r_ids.take(pa.array(right[j])), pa.array(sims)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"])

    return kernel


def _top_kernel(k: int, threshold: float | None, strict: bool) -> Kernel:
    """The k best right rows of every left row of the unit (ties to the lower id)."""

    def kernel(table: pa.Table) -> pa.Table:
        l_ids, r_ids, values, left, right = _cross_sides(table)
        order = np.asarray(pc.sort_indices(r_ids.take(pa.array(right))))
        right = right[order]
        picked, where, sims = top_of(values[left], values[right], k)
        if threshold is not None:
            ok = sims > threshold if strict else sims >= threshold
            picked, where, sims = picked[ok], where[ok], sims[ok]
        return pa.table(
            [l_ids.take(pa.array(left[picked])), r_ids.take(pa.array(right[where])), pa.array(sims)],
            names=["a", "b", "similarity"],
        )

    return kernel


def top_of(left: np.ndarray, right: np.ndarray, k: int):
    """(left row, right row, similarity) of the k largest products per left row.

    Equal products rank by position.  Only the rows that reach the k-th value are sorted.
    """
    k = min(k, len(right))
    if k == 0 or not len(left):
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0)
    if k == 1:
        best, sims = best_of(left, right)
        return np.arange(len(left)), best, sims
    parts = []
    step = max(1, SCRATCH_ELEMENTS // len(right))
    for start in range(0, len(left), step):
        block = np.round(left[start : start + step] @ right.T, 12)
        last = np.partition(block, len(right) - k, axis=1)[:, len(right) - k]
        i, j = np.nonzero(block >= last[:, None])
        values = block[i, j]
        order = np.lexsort((j, -values, i))
        i, j, values = i[order], j[order], values[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        parts.append((i[kept] + start, j[kept], values[kept]))
    return _joined(parts)


def _fits_broadcast(df: DataFrame, key: str, vector: str, limit: int) -> bool:
    size = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(vector)).alias("d"),
        F.max(F.length(F.col(key).cast("string"))).alias("w"),
    ).first()
    return (size["n"] or 0) * (8 * max(size["d"] or 0, 0) + (size["w"] or 0)) <= limit


def top_matches(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    left_vector: str,
    right_key: str,
    right_vector: str,
    k: int = 1,
    threshold: float | None = None,
    strict: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    unit_rows_limit: int | None = None,
    pivots: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """(a, b, similarity, rank): the k most similar right rows of every left row.

    Ties go to the lower right id.  A right table under ``broadcast_bytes`` is broadcast
    after its size was checked and the left table is read once without a shuffle.
    Beyond that both tables meet in work units, in two exact steps: the k best around a
    row's own pivot bound its k-th best similarity from below, and with that bound the
    row visits only the cells that can still improve it.
    """
    schema = _pair_schema(
        left.schema[left_key].dataType, right.schema[right_key].dataType, ("a", "b")
    )
    dim = dimension_of(right, right_vector) if dim is None else dim
    left, right = _one_length(left, left_vector, dim), _one_length(right, right_vector, dim)
    names = (left_key, left_vector, right_key, right_vector)
    if _fits_broadcast(right, right_key, right_vector, broadcast_bytes):
        pick = _picker(k, threshold, strict)
        best = _by_broadcast(left, right, *names, pick, schema)
        if k == 1:
            return best.withColumn("rank", F.lit(1))
        return _ranked(best, k)
    floor = -1.0 if threshold is None else threshold
    right, layout = _place(right, right_key, right_vector, floor, unit_rows_limit, pivots, False)
    bound = None
    if layout.pivots is not None:
        near = _visited(left, left_vector, replace(layout, own_pivot_only=True), False)
        first = _run_units(_two_tables(left, right, *names, near), _top_kernel(k, None, False), schema)
        kth = _ranked(first, k).where(F.col("rank") == k).select(
            F.col("a").alias(left_key), F.col("similarity").alias("_bound")
        )
        bounded = left.select(left_key, left_vector).join(kth, left_key, "left")
        left = materialize(bounded.withColumn("_bound", F.coalesce("_bound", F.lit(-1.0))), "bounds")
        bound = "_bound"
    layout = _visited(left, left_vector, layout, False, bound)
    spread = _two_tables(left, right, *names, layout, bound)
    return _ranked(_run_units(spread, _top_kernel(k, threshold, strict), schema), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _picker(k: int, threshold: float | None, strict: bool):
    def pick(l_matrix: np.ndarray, r_matrix: np.ndarray):
        picked, where, sims = top_of(l_matrix, r_matrix, k)
        if threshold is not None:
            ok = sims > threshold if strict else sims >= threshold
            picked, where, sims = picked[ok], where[ok], sims[ok]
        return [(picked, where, sims)]

    return pick


def _by_broadcast(left, right, left_key, left_vector, right_key, right_vector, pick, schema) -> DataFrame:
    """``pick`` between every batch of the left table and the whole right one, in id order."""
    table = right.select(right_key, right_vector).toArrow()
    matrix, kept = unit_rows(table.column(1))
    ids = table.column(0).combine_chunks().take(pa.array(kept))
    order = np.asarray(pc.sort_indices(ids))
    shared = left.sparkSession.sparkContext.broadcast((ids.take(pa.array(order)), matrix[order]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r_ids, r_matrix = shared.value
        for batch in batches:
            l_matrix, rows = unit_rows(batch.column(1))
            if not len(rows) or not len(r_matrix):
                continue
            for picked, where, sims in pick(l_matrix, r_matrix):
                a, b = batch.column(0).take(pa.array(rows[picked])), r_ids.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(sims)], ["a", "b", "similarity"])

    return left.select(left_key, left_vector).mapInArrow(match, schema)


def argmax_match(
    clusters: DataFrame,
    profiles: DataFrame,
    cluster_key: str,
    cluster_vector: str,
    profile_key: str,
    profile_vector: str,
    threshold: float | None = None,
    **options,
) -> DataFrame:
    """Best profile per cluster (a, b, similarity); ties go to the lower profile id."""
    best = top_matches(
        clusters, profiles, cluster_key, cluster_vector, profile_key, profile_vector,
        k=1, threshold=threshold, **options,
    )
    return best.drop("rank")


def knn_search(
    queries: DataFrame,
    vectors: DataFrame,
    query_key: str,
    query_vector: str,
    key: str,
    vector: str,
    k: int = 10,
    broadcast_bytes: int = BROADCAST_BYTES,
    unit_rows_limit: int | None = None,
    pivots: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """(query, neighbour, similarity, rank): the k nearest rows of ``vectors``.

    A few queries (``BROADCAST_QUERIES``, and under ``broadcast_bytes``) are broadcast and
    every task keeps the k best per query of its rows.  More queries would make that
    k rows per query and task, so they meet the vectors as in ``top_matches``.
    """
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    if few and _fits_broadcast(queries, query_key, query_vector, broadcast_bytes):
        schema = _pair_schema(
            queries.schema[query_key].dataType, vectors.schema[key].dataType, ("a", "b")
        )
        dim = dimension_of(vectors, vector) if dim is None else dim
        queries, vectors = _one_length(queries, query_vector, dim), _one_length(vectors, vector, dim)
        best = _knn_by_broadcast(queries, vectors, query_key, query_vector, key, vector, k, schema)
        ranked = _ranked(best, k)
    else:
        ranked = top_matches(
            queries, vectors, query_key, query_vector, key, vector, k, broadcast_bytes=broadcast_bytes,
            unit_rows_limit=unit_rows_limit, pivots=pivots, dim=dim,
        )
    return ranked.withColumnsRenamed({"a": "query", "b": "neighbour"})


def _knn_by_broadcast(queries, vectors, query_key, query_vector, key, vector, k, schema):
    table = queries.select(query_key, query_vector).toArrow()
    matrix, kept = unit_rows(table.column(1))
    ids = table.column(0).combine_chunks().take(pa.array(kept))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_matrix = shared.value
        best = None  # the k best per query of this task: (query, neighbour id, similarity)
        for batch in batches:
            v_matrix, rows = unit_rows(batch.column(1))
            if not len(rows) or not len(q_matrix):
                continue
            neighbours = batch.column(0).take(pa.array(rows))
            order = np.asarray(pc.sort_indices(neighbours))
            picked, where, sims = top_of(q_matrix, v_matrix[order], k)
            found = pa.table(
                [pa.array(picked), neighbours.take(pa.array(order[where])), pa.array(sims)],
                names=["q", "b", "s"],
            )
            best = found if best is None else _keep_best(pa.concat_tables([best, found]), k)
        if best is not None:
            a = q_ids.take(best.column("q").combine_chunks())
            columns = [a, best.column("b").combine_chunks(), best.column("s").combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"])

    return vectors.select(key, vector).mapInArrow(search, schema)


def _keep_best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows per query of a (q, b, s) table."""
    ordered = table.sort_by([("q", "ascending"), ("s", "descending"), ("b", "ascending")])
    q = np.asarray(ordered.column("q").combine_chunks())
    starts = np.searchsorted(q, q, "left")
    return ordered.take(pa.array(np.flatnonzero(np.arange(len(q)) - starts < k)))
