"""Quality scores by nearest-neighbour voting in a latent semantic space.

A document is a bag of hashed words and word shapes.  A truncated singular value decomposition of
labelled documents gives the latent space; the labelled vectors are broadcast, every document is
compared with all of them in blocks of exact cosine products, and its nearest ones vote with their
labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.llm.base import col, strings
from clanmark.llm.words import buffers, byte_slices, word_spans

#: Labelled documents that are fitted and vote: those with the lowest hash of their id.
VOTERS = 8192
#: Neighbours that vote on a document, and the power of similarity that weighs a vote.
NEIGHBOURS = 48
POWER = 4
RANK = 64
WORD_SLOTS, SHAPE_SLOTS = 1024, 512
SLOTS = WORD_SLOTS + SHAPE_SLOTS
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024
#: Documents that meet all voters in one product.
BLOCK_ROWS = 128
THRESHOLD = 0.7

_UPPER, _DIGIT, _STOP, _SIGN = 1, 2, 4, 8
BYTE_KIND = np.zeros(256, dtype=np.uint8)
BYTE_KIND[ord("A") : ord("Z") + 1] = _UPPER
BYTE_KIND[ord("0") : ord("9") + 1] = _DIGIT
for _c in range(33, 127):
    if not chr(_c).isalnum():
        BYTE_KIND[_c] = _STOP if chr(_c) in ".,;:'\"-" else _SIGN
LENGTH_CLASS = np.minimum(np.array([0, 0, 1, 2, 3, 3, 4, 4, 4, *[5] * 5, *[6] * 50]), 6)


def features(texts: pa.Array) -> np.ndarray:
    """Counts of hashed words and of word shapes, a row per text.

    The shape of a word: capitals (none, some, most), digits, signs and stops inside, its length, and
    whether it repeats one of the two words before it.
    """
    n = len(texts)
    hashes, first, end, offsets = word_spans(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = BYTE_KIND[buffers(texts)[0]]

    def count(flag: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((kind & flag) != 0, dtype=np.int32)])
        return sums[end] - sums[first]

    length = end - first
    upper, digit, stop, sign = (count(flag) for flag in (_UPPER, _DIGIT, _STOP, _SIGN))
    capitals = np.where(upper == 0, 0, np.where(2 * upper > length, 2, 1))
    again = np.zeros(len(hashes), dtype=np.int64)
    for back in (1, 2):
        same = (hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])
        again[back:] |= same
    signs = np.where(sign == 0, 0, np.where(sign < length, 1, 2))
    shape = (((capitals * 2 + (digit > 0)) * 2 + (stop > 0)) * 3 + signs) * 14 + LENGTH_CLASS[np.minimum(length, 60)] * 2 + again
    counts = np.bincount(row * SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=n * SLOTS)
    counts += np.bincount(row * SLOTS + WORD_SLOTS + shape, minlength=n * SLOTS)
    return counts.reshape(n, SLOTS).astype(np.float32)


@dataclass
class Model:
    """What is broadcast: at most ``VOTERS`` x (``RANK`` + 1) numbers and a projection of fixed size."""

    weights: np.ndarray
    projection: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for a text without words."""
        return _units(weighed(counts, self.weights) @ self.projection)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest voters; the share of all voters for a zero vector."""
        blocks = [self._votes(counts[i : i + BLOCK_ROWS]) for i in range(0, len(counts), BLOCK_ROWS)]
        return np.concatenate([np.zeros(0), *blocks])

    def _votes(self, counts: np.ndarray) -> np.ndarray:
        cosine = self.latent(counts) @ self.voters.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0.0) ** POWER
        total = weight.sum(1)
        share = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1.0)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0.0, 1.0)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def weighed(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the parts of words and of shapes, weighed; either block has norm 1 before."""
    words = np.maximum(counts[:, :WORD_SLOTS].sum(1, keepdims=True), 1.0)
    return np.sqrt(counts / words) * weights


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """Inverse document frequencies for words, a fixed weight for shapes, and the top right singular vectors."""
    seen = (counts > 0).mean(0)
    weights = np.log((1.0 + 1e-3) / (seen + 1e-3)).astype(np.float32)
    weights[WORD_SLOTS:] = 1.0
    x = weighed(counts, weights)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = np.ascontiguousarray(vectors[:, ::-1][:, :rank], dtype=np.float32)
    return Model(weights, projection, _units(x @ projection), labels.astype(np.float64))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _parts(strings(batch.column("text"))):
            counts = features(texts)
            rows = [np.flatnonzero(row) for row in counts]
            columns = [
                batch.column("quality").slice(first, len(texts)),
                pa.array([at.astype(np.int16).tobytes() for at in rows], pa.binary()),
                pa.array([row[at].tobytes() for row, at in zip(counts, rows, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "slots", "counts"])


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for first, part in byte_slices(texts, SLICE_BYTES):
        for at in range(0, len(part), SLICE_ROWS):
            yield first + at, part.slice(at, SLICE_ROWS)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", voters: int = VOTERS) -> Model | None:
    """A model of at most ``voters`` labelled documents that are not held out; None without any.

    Chosen by the hash of their id among all labels; several labels of one document count as their
    mean; null ids and labels are left out.
    """
    known = labels.where(col("quality").isNotNull() & col(doc_id).isNotNull() & ~held_out(col(doc_id)))
    known = known.groupBy(col(doc_id).cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    own = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    # Labels of ids that are no document do not take a place.
    there = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(voters)
    found = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("own"))
    rows = found.select("doc_id", "own.*").mapInArrow(_sparse, "quality double, slots binary, counts binary").collect()
    if not rows:
        return None
    counts = np.zeros((len(rows), SLOTS), dtype=np.float32)
    for out, row in zip(counts, rows, strict=True):
        out[np.frombuffer(row.slots, np.int16)] = np.frombuffer(row.counts, np.float32)
    return fit(counts, np.array([r.quality for r in rows]))


def _scored(model, field: str | None):
    """Adds the scores of the column ``text``, which is dropped, or of a field of the column ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            column = batch.column("text") if field is None else batch.column("row").field(field)
            for _, texts in _parts(strings(column)):
                scores.append(model.value.score(features(texts)))
            kept = batch.drop_columns(["text"]) if field is None else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(scores), pa.float64())], [*kept.schema.names, "score"])

    return run


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the score, 0 to 1, of every row's whole text.

    Null texts are empty; texts without words, or without a model all texts, get the share of label 1
    among the voters (0.5 without a model).  Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    if model is None:
        return docs.select(*[col(c) for c in keep], F.lit(0.5).alias("score"))
    inside = keep == ("row",)  # the text is a field of the row and goes to the task once
    own = docs.select(*[col(c) for c in keep], *([] if inside else [col(text).cast("string").alias("text")]))
    kind = own.drop("text").withColumn("score", F.lit(0.0)).schema
    return own.mapInArrow(_scored(spark.sparkContext.broadcast(model), text if inside else None), kind)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document: predicted 1 at a score of 0.7 or more."""
    own = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    scored = score_texts(own, train(own, labels))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted 0; their columns as they were."""
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"))
    scored = score_texts(rows, train(docs, labels), keep=("row",)).where(F.col("score") >= THRESHOLD)
    return scored.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
