"""Hard negatives with rotated one-bit codes.

A vector is rotated (sign flips and Hadamard transforms) and approximated in levels: the signs of what is
left are one code, scaled by its alignment, the inner product of code and rest; the next level codes the
new rest.  A query is rounded to a few bits per component, so its product with a code is a handful of
popcounts.  The sum over the levels estimates the inner product, and by Cauchy-Schwarz the estimate is wrong by at
most |query| x |rest| and the query's rounding: an interval that holds for certain.  Only candidates whose
interval meets what is asked for are scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clanmark.llm.base import col
from clanmark.llm.vectors import by_length, floored, packed, unpacked
from clanmark.sources.workspace import materialize, release

SCALE = 256
#: Codes per vector, and bits per component of a query.
LEVELS, PLANES = 4, 6
POSITIVES, NEGATIVES, LABELS = 5, 5, 10
#: Bytes of the anchors that one pass over the table broadcasts; rows and pairs that are bounded at once.
PART_BYTES, BLOCK_ROWS, BLOCK_PAIRS = 16 << 20, 4096, 1 << 20
#: Pairs that are scored at once, and candidates that an anchor scores before it knows a least score.
SCORED, FIRST = 1 << 15, 16

TABLE = "vec_id long, label long, dim int, vec binary, codes binary, scales binary, rest double"


def width(dim: int) -> int:
    """Length of a rotated vector: the next power of two, 64 at least."""
    return max(64, 1 << (dim - 1).bit_length())


def rotated(rows: np.ndarray, seed: int = 11) -> np.ndarray:
    """The rows in ``width`` dimensions, turned by two rounds of fixed sign flips and a Hadamard transform."""
    size = width(rows.shape[1])
    signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (2, size))
    x = np.zeros((len(rows), size))
    x[:, : rows.shape[1]] = rows
    for flip in signs:
        x *= flip
        half = 1
        while half < size:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
            half *= 2
        x /= np.sqrt(size)
    return x


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encoded(rows: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, words), the factor of each code's +1/-1 vector, and the length of what they leave."""
    left = rotated(rows)
    codes = np.empty((len(rows), levels, left.shape[1] // 64), dtype="<u8")
    scales = np.empty((len(rows), levels))
    for level in range(levels):
        positive = left > 0
        codes[:, level] = _words(positive)
        scales[:, level] = np.abs(left).mean(1)
        left -= np.where(positive, scales[:, level, None], -scales[:, level, None])
    return codes, scales, np.sqrt((left * left).sum(1))


class Part:
    """Anchors of one length and what their intervals and windows need."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, planes: int = PLANES):
        self.ids, self.labels, self.rows = ids, labels, rows
        turned = rotated(rows)
        self.least = turned.min(1) if len(rows) else np.zeros(0)
        self.step = np.maximum((turned.max(1) - self.least if len(rows) else np.zeros(0)) / ((1 << planes) - 1), 1e-300)
        whole = np.rint((turned - self.least[:, None]) / self.step[:, None])
        rounded = self.least[:, None] + self.step[:, None] * whole
        self.sums, self.off = rounded.sum(1), np.abs(turned - rounded).sum(1)
        self.norms = np.sqrt((turned * turned).sum(1))
        self.planes = np.stack([_words((whole.astype(np.int64) >> b) & 1 == 1) for b in range(planes)], 1)

    def intervals(self, some: slice, codes: np.ndarray, scales: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and half widths, a row per anchor and a column per candidate.

        The +1/-1 product is twice the sum over set bits less the sum of all: popcounts of code and
        bit planes for the steps, of the code alone for the least value.
        """
        planes = self.planes[some]
        estimate = np.zeros((len(planes), len(codes)))
        for level in range(codes.shape[1]):
            counts = np.zeros(estimate.shape, dtype=np.int32)
            ones = np.bitwise_count(codes[:, level]).sum(1, dtype=np.int32)
            for b in range(planes.shape[1]):
                for word in range(codes.shape[2]):
                    counts += np.bitwise_count(planes[:, b, word, None] & codes[None, :, level, word]).astype(np.int32) << b
            product = 2 * (self.step[some, None] * counts + self.least[some, None] * ones) - self.sums[some, None]
            estimate += scales[:, level] * product
        total = scales.sum(1)
        error = self.norms[some, None] * rest + self.off[some, None] * total
        return estimate, error + 1e-9 * self.norms[some, None] * (total * np.sqrt(codes.shape[2] * 64.0) + rest) + 1e-6

    def spans(self, candidates: int) -> Iterator[slice]:
        step = max(1, BLOCK_PAIRS // max(1, candidates))
        for first in range(0, len(self.ids), step):
            yield slice(first, min(first + step, len(self.ids)))


class Block:
    """Candidates of one length."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column("vec_id").to_numpy()
        self.labels = batch.column("label").to_numpy()
        self.rows = unpacked(batch.column("vec"))
        scales = unpacked(batch.column("scales"), "<f8")
        self.codes = unpacked(batch.column("codes"), "<u8").reshape(len(self.ids), scales.shape[1], -1)
        self.scales, self.rest = scales, batch.column("rest").to_numpy()

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers; components are clipped so that they stay below 2**62."""
        return np.concatenate([np.zeros(0, np.int64), *[self.rows[at[i : i + SCORED]] @ query for i in range(0, len(at), SCORED)]])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class _Positives:
    """The k best rows of an anchor's own label among what a task has seen."""

    def __init__(self, part: Part, k: int):
        self.part, self.k = part, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in part.ids]

    def see(self, block: Block) -> None:
        for some in self.part.spans(len(block.ids)):
            estimate, error = self.part.intervals(some, block.codes, block.scales, block.rest)
            own = (block.labels == self.part.labels[some, None]) & (block.ids != self.part.ids[some, None])
            for a, (row, wide, allowed) in enumerate(zip(estimate, error, own, strict=True), some.start):
                self._anchor(a, block, np.flatnonzero(allowed), row, wide)

    def _anchor(self, a: int, block: Block, at: np.ndarray, estimate: np.ndarray, error: np.ndarray) -> None:
        if len(self.best[a][0]) < self.k and len(at) > FIRST:
            first = np.argpartition(-estimate[at], FIRST)[:FIRST]
            self._add(a, block, at[first])
            at = np.delete(at, first)
        ids, scores = self.best[a]
        if len(ids) == self.k:
            at = at[estimate[at] + error[at] >= scores[-1]]
        self._add(a, block, at)

    def _add(self, a: int, block: Block, at: np.ndarray) -> None:
        ids = np.concatenate([self.best[a][0], block.ids[at]])
        scores = np.concatenate([self.best[a][1], block.scores(at, self.part.rows[a])])
        keep = _best(ids, scores, self.k)
        self.best[a] = ids[keep], scores[keep]

    def hits(self) -> Iterator[pa.RecordBatch]:
        counts = [len(ids) for ids, _ in self.best]
        columns = [np.repeat(self.part.ids, counts), *(np.concatenate(x) if self.best else np.zeros(0, np.int64) for x in zip(*self.best))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "vec_id", "score"])


class _Negatives:
    """For each positive of an anchor the k best rows of another label inside its window of scores."""

    def __init__(self, part: Part, k: int, positives: list[list[tuple[int, int]]]):
        self.part, self.k, self.positives = part, k, positives
        none = np.zeros(0, np.int64)
        self.best = [[(none, none)] * len(own) for own in positives]
        # 4p <= 5n is n >= p - p // 5 in whole numbers
        self.floors = [[score - score // 5 for _, score in own] for own in positives]

    def see(self, block: Block) -> None:
        for some in self.part.spans(len(block.ids)):
            estimate, error = self.part.intervals(some, block.codes, block.scales, block.rest)
            other = block.labels != self.part.labels[some, None]
            for a in range(some.start, some.stop):
                if self.positives[a]:
                    row = a - some.start
                    high, low = estimate[row] + error[row], estimate[row] - error[row]
                    wanted = (high >= min(self.floors[a])) & (low <= max(score for _, score in self.positives[a]))
                    self._anchor(a, block, np.flatnonzero(wanted & other[row]))

    def _anchor(self, a: int, block: Block, at: np.ndarray) -> None:
        scores = block.scores(at, self.part.rows[a])
        for i, (_, top) in enumerate(self.positives[a]):
            inside = np.flatnonzero((scores >= self.floors[a][i]) & (scores <= top))
            if not len(inside):
                continue
            ids = np.concatenate([self.best[a][i][0], block.ids[at[inside]]])
            values = np.concatenate([self.best[a][i][1], scores[inside]])
            keep = _best(ids, values, self.k)
            self.best[a][i] = ids[keep], values[keep]
            if len(keep) == self.k:
                self.floors[a][i] = max(self.floors[a][i], int(values[keep[-1]]))

    def hits(self) -> Iterator[pa.RecordBatch]:
        rows = [
            (anchor, i, positive, score, int(n), int(s))
            for anchor, own, best in zip(self.part.ids.tolist(), self.positives, self.best, strict=True)
            for i, ((positive, score), (ids, scores)) in enumerate(zip(own, best, strict=True))
            for n, s in zip(ids, scores, strict=True)
        ]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(6)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])


def _coded(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, rows in by_length(batch, "vector"):
                step = max(1, BLOCK_PAIRS // width(dim))
                for i in range(0, len(at), step):
                    own, where = rows[i : i + step], pa.array(at[i : i + step])
                    codes, scales, rest = encoded(own, levels)
                    columns = [batch.column("vec_id").take(where), batch.column("label").take(where), pa.array(np.full(len(own), dim), pa.int32())]
                    columns += [packed(own), packed(codes.reshape(len(own), -1)), packed(scales), pa.array(rest)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in TABLE.split(", ")])

    return run


def code_table(vectors: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows (vec_id, label, vector of whole numbers) with their codes, scales and rests, written once."""
    return materialize(vectors.mapInArrow(_coded(levels), TABLE), "codes")


def _search(seekers):
    """``seekers``: the broadcast makers of a searcher per length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {dim: make() for dim, make in seekers.value.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim, seeker in own.items():
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), BLOCK_ROWS):
                    seeker.see(Block(batch.take(pa.array(at[i : i + BLOCK_ROWS]))))
        for seeker in own.values():
            yield from seeker.hits()

    return run


class _Maker:
    """Makes a searcher in a task: the anchors' bits are computed there and not sent."""

    def __init__(self, kind, *args):
        self.kind, self.args = kind, args

    def __call__(self):
        ids, labels, rows, *more = self.args
        return self.kind(Part(ids, labels, rows), *more)


def _parts(asked: DataFrame, part_bytes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The anchors in parts of about ``part_bytes``, one anchor at least; the driver has one part at a time."""
    facts = asked.agg(F.sum(F.octet_length("vec") + 64).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = min(-(-(facts["bytes"] or 0) // part_bytes), facts["n"])
    for part in range(parts):
        rows = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        held: dict[int, list] = {}
        for row in rows.select("vec_id", "label", "dim", "vec").collect():
            held.setdefault(row["dim"], []).append(row)
        if held:
            yield {
                dim: (
                    np.array([r["vec_id"] for r in own], dtype=np.int64),
                    np.array([r["label"] for r in own], dtype=np.int64),
                    np.frombuffer(b"".join(bytes(r["vec"]) for r in own), "<i8").reshape(len(own), dim),
                )
                for dim, own in held.items()
            }


def _first(df: DataFrame, keys: list[str], score: str, key: str, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    levels: int = LEVELS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id LONG, label LONG, vector ARRAY<LONG>; ``is_anchor`` is a condition on vec_id.  An
    anchor's positives are its first ``positives`` other rows of its label by inner product, highest first,
    ties to the smaller vec_id; a positive's negatives the first ``negatives`` rows of other labels
    whose score is at most the positive's and at least 0.8 of it.  There may be fewer of both, or none.

    Rows with a null id, label or vector, or an empty vector, take no part; vectors of different
    lengths have no product.  An anchor id that occurs more than once stands for its least row and is no
    candidate of itself; other repeated rows count once each.  Components are clipped to
    ``vectors.largest`` (2**28 for 64 dimensions), so every score fits in a LONG.

    A part of the anchors makes two passes over the codes, for positives and then for negatives in their
    windows; each task returns the best of what it has seen.
    """
    spark = vectors.sparkSession
    usable = vectors.select(*[F.col(c).cast(t).alias(c) for c, t in (("vec_id", "long"), ("label", "long"), ("vector", "array<bigint>"))])
    usable = usable.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
    table = code_table(usable, levels)
    own = F.min(F.struct("label", "dim", "vec")).alias("own")
    asked = materialize(table.where(is_anchor).groupBy("vec_id").agg(own).select("vec_id", "own.*"), "anchors")
    kind = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = []
    for part in _parts(asked, part_bytes):
        seekers = spark.sparkContext.broadcast({dim: _Maker(_Positives, *own, positives) for dim, own in part.items()})
        hits = table.mapInArrow(_search(seekers), "anchor_id long, vec_id long, score long")
        near: dict[int, list] = {}
        for r in _first(hits, ["anchor_id"], "score", "vec_id", positives).orderBy("anchor_id", "rank").collect():
            near.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
        windows = {
            dim: _Maker(_Negatives, *own, negatives, [near.get(i, []) for i in own[0].tolist()]) for dim, own in part.items()
        }
        hits = table.mapInArrow(_search(spark.sparkContext.broadcast(windows)), kind)
        found.append(materialize(_first(hits, ["anchor_id", "place"], "negative_score", "negative_id", negatives), "negatives"))
    release(asked, table)
    out = found[0] if found else spark.createDataFrame([], kind + ", rank int")
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df: DataFrame) -> DataFrame:
    """``hard_negatives`` of a table (vec_id, embedding, label), components as floor(256 * x).

    Where vec_id is divisible by 7 the label is first shifted by one modulo ``LABELS``; anchors are the rows
    whose vec_id is divisible by 100.
    """
    label = F.when(col("vec_id") % 7 == 0, (col("label") + 1) % LABELS).otherwise(col("label"))
    vectors = df.select(col("vec_id").alias("vec_id"), label.alias("label"), floored("embedding", SCALE).alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)
