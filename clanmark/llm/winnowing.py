"""Line deduplication by winnowing: runs of lines that occur earlier in the corpus are deleted.

The hash of every line is taken.  A window is a run of lines that just reaches ``min_words`` words,
from its first line on or from its last line back; its fingerprint is the line of least hash in it, so
two equal runs of ``min_words`` words always have a window, and with it a fingerprint, in common.
Fingerprints that occur once can't lie in a repeated run and drop out.  Of equal windows the first one
stays, and the lines of later ones are deleted.

This deletes every match at its full extent: a line of a repeated run lies in the window that ends with
it if the run has ``min_words`` words up to there, and else in the window that starts with the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.llm.base import col, schema, strings
from clanmark.llm.words import buffers, byte_slices, mixed, powers, word_spans
from clanmark.sources.workspace import materialize

#: Words of the shortest run that counts as repeated.
MIN_WORDS = 50
SLICE_BYTES = 4 << 20
_ORDER = 0xC2B2AE3D27D4EB4F

WINDOWS = "uid long, first_line int, last_line int, at int, fingerprint long, w1 long, w2 long"


def line_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and words of every line of all texts, and where each text's lines begin.

    Lines end at line breaks; equal lines have equal words (A-Z lower-cased), white space aside.
    """
    data, offsets = buffers(texts)
    hashes, first, _, _ = word_spans(texts)
    breaks = np.flatnonzero(data == 10)
    # A line begins at every text and after every line break.
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    lines = np.searchsorted(np.sort(breaks), offsets) + np.arange(len(offsets))
    line = lines_of(first, offsets, breaks)
    counts = np.bincount(line, minlength=len(starts))
    ends = np.cumsum(counts)
    begin = ends - counts
    place = np.arange(len(hashes)) - np.repeat(begin, counts)
    step = powers(_ORDER, int(counts.max(initial=0)) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mixed(hashes ^ np.uint64(_ORDER)) * step[place], out=sums[1:])
    return mixed(sums[ends] - sums[begin] + counts.astype(np.uint64)), counts, lines


def lines_of(at: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The number of the line that each byte position lies in, counted over all texts."""
    text = np.searchsorted(offsets, at, "right") - 1
    return np.searchsorted(breaks, at) + text


def windows(hashes: np.ndarray, counts: np.ndarray, lines: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """First and last line, place of the least hash, that hash, and two hashes of each window.

    A window starts at every line with words from which its text still has ``min_words`` words, and one
    ends at every line with words up to which it has as many.  Blank lines lie inside windows but
    neither start nor end one; a line that is a window by itself is one with the line with words before
    it too, so that blank lines between them are inside.
    """
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(counts)])
    begin, stop = (np.repeat(x, np.diff(lines)) for x in (lines[:-1], lines[1:]))
    reach = np.searchsorted(total, total[:-1] + min_words) - 1
    first = np.flatnonzero((reach < stop) & (counts > 0))
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ends = np.flatnonzero((back >= begin) & (counts > 0))
    ends = ends[reach[back[ends]] != ends]  # the others are windows already
    before = np.maximum.accumulate(np.where(counts > 0, np.arange(n), -1))
    before = np.concatenate([[-1], before[:-1]]) if n else before
    apart = np.flatnonzero((counts >= min_words) & (before >= begin))
    apart = apart[reach[before[apart]] != apart]
    last = np.concatenate([reach[first], ends, apart])
    first = np.concatenate([first, back[ends], before[apart]])
    order = np.where(counts > 0, mixed(hashes ^ np.uint64(1)), np.uint64((1 << 64) - 1))
    least, length = first.copy(), last - first
    for step in range(1, int(length.max(initial=0)) + 1):
        wide = np.flatnonzero(length >= step)
        here = first[wide] + step
        least[wide] = np.where(order[here] <= order[least[wide]], here, least[wide])
    solid = np.where(counts > 0, hashes, np.uint64(0))
    rank = np.concatenate([[0], np.cumsum(counts > 0)])  # blank lines take no place in a window's hash
    found = []
    for base in (_ORDER, 0x9E3779B97F4A7C15):
        inverse = pow(base, -1, 1 << 64)
        step, back = powers(base, n + 1), powers(inverse, n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(counts > 0, mixed(solid ^ np.uint64(base)) * step[rank[:-1]], np.uint64(0)))])
        found.append(mixed((sums[last + 1] - sums[first]) * back[rank[first]]))
    return first, last, least, hashes[least], found[0], found[1]


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for at, texts in byte_slices(strings(batch.column("text")), SLICE_BYTES):
                hashes, counts, lines = line_table(texts)
                first, last, least, mark, w1, w2 = windows(hashes, counts, lines, min_words)
                doc = np.searchsorted(lines, first, "right") - 1
                base = lines[doc]
                columns = [
                    pa.array(uids[at + doc]),
                    *[pa.array((x - base).astype(np.int32)) for x in (first, last, least)],
                    *[pa.array(x.view(np.int64)) for x in (mark, w1, w2)],
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WINDOWS.split(", ")])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + batch.num_rows)), *batch.columns], ["uid", *batch.schema.names])
        uid += batch.num_rows


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, lines): the numbers of the lines to delete, of rows (uid, doc_id, text).

    Positions are ordered by doc_id (null last), uid and line.
    """
    found = materialize(rows.select("uid", "text").mapInArrow(_windows(min_words), WINDOWS), "windows")
    marks = found.groupBy("fingerprint").agg(F.min(F.struct("uid", "at")).alias("a"), F.max(F.struct("uid", "at")).alias("b"))
    twice = marks.where(F.col("a") != F.col("b")).select("fingerprint")
    near = found.join(twice, "fingerprint", "left_semi").join(rows.select("uid", "doc_id"), "uid")
    near = materialize(near.withColumn("place", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid", "first_line")), "near")
    earliest = near.groupBy("w1", "w2").agg(F.min("place").alias("stays"), F.count("*").alias("n")).where("n > 1")
    later = near.join(earliest.drop("n"), ["w1", "w2"]).where(F.col("place") != F.col("stays"))
    spans = later.select("uid", F.explode(F.sequence("first_line", "last_line")).alias("line")).distinct()
    return spans.groupBy("uid").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_repeated_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS
) -> DataFrame:
    """(text, deleted, row, doc_id): every row of ``docs`` with its text less the repeated runs.

    A line is deleted if it lies in a run of lines of at least ``min_words`` words that occurs earlier,
    in a document of smaller doc_id (null last) or higher up in the same one, so an earlier copy of
    each deleted line stays somewhere.  Runs are compared by words, A-Z lower-cased.  ``deleted``: the numbers of the deleted
    lines, from 0.  Null texts stay null, empty ones empty; repeated rows are later copies of the
    first one read.  Lines of more than ``min_words`` words are runs by themselves.
    """
    row = F.struct(*[col(c) for c in keep]).alias("row")
    own = docs.select(row, col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    rows = materialize(own.mapInArrow(_numbered, schema("uid long", **{f.name: f.dataType for f in own.schema})), "lines")
    spans = repeated_runs(rows, min_words)
    joined = rows.join(spans, "uid", "left")
    kind = schema("text string, deleted array<int>", row=own.schema["row"].dataType, doc_id=T.LongType())
    return joined.select("row", "doc_id", "text", "lines").mapInArrow(_cleaned, kind)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = batch.column("text").to_pylist(), batch.column("lines").to_pylist()
        for i, gone in enumerate(lists):
            if gone:
                dropped = set(gone)
                texts[i] = "\n".join(line for n, line in enumerate(texts[i].split("\n")) if n not in dropped)
        deleted = pa.array([gone or [] for gone in lists], pa.list_(pa.int32()))
        columns = [pa.array(texts, pa.string()), deleted, batch.column("row"), batch.column("doc_id")]
        yield pa.RecordBatch.from_arrays(columns, ["text", "deleted", "row", "doc_id"])
