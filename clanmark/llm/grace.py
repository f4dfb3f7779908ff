"""Exact deduplication after the Grace hash join.

Every task first folds the copies inside its own batches, so a text that fills a third of the
corpus leaves a task once per batch.  One row per distinct content of a batch is then dealt by
hash into buckets; Spark's shuffle files are the spill files.  A bucket over ``bucket_bytes`` is
dealt again with another hash, level by level, until each fits the open-addressing table of its
task, which compares complete contents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.llm.base import col, schema, whole_row
from clanmark.sources.workspace import materialize

#: Deleted before texts are compared: `[\x20\x09-\x0D]`.
BLANKS = b" \t\n\x0b\x0c\r"
BUCKET_BYTES = 32 << 20
FAN = 16

FOLDED = "uid long, doc_id long, n_chars long, hash long, sha256 binary, n_bytes long, first boolean, n long, keep_chars long, keep_id long, keep_uid long"
CLASSES = "sha256 binary, keep_uid long, keep_id long, group_size long"


class ContentTable:
    """Open addressing with linear probing; an entry is found only if its whole content is equal."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def put(self, key: int, content: bytes) -> int:
        """The number of the entry with this content, a new one if there is none."""
        slots, mask = self.slots, len(self.slots) - 1
        at = key & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        entry = slots[at] = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        if 2 * len(self.hashes) > len(slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def normalised(text: bytes | None) -> bytes:
    return text.translate(None, BLANKS) if text else b""


def _rank(n_chars: int, doc_id: int | None, uid: int) -> tuple:
    """The lowest stays: most code points, then smallest doc_id (null last), then first read."""
    return -n_chars, doc_id is None, doc_id or 0, uid


def _fold(text: str, doc_id: str):
    """Rows of documents, each with its digest; copies within a batch folded into their first row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = batch.column("row")
            texts = rows.field(text)
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            ids = rows.field(doc_id).cast(pa.int64()).to_pylist()
            found = ContentTable(1 << 14)
            groups: list[list] = []
            out: list[tuple] = []
            for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                content = normalised(raw)
                key = xxhash.xxh3_64_intdigest(content)
                entry = found.put(key, content)
                rank = _rank(lengths[i], ids[i], uid + i)
                if entry == len(groups):
                    digest = hashlib.sha256(content).digest()
                    groups.append([i, 1, rank, digest, (key ^ (1 << 63)) - (1 << 63), len(content)])
                else:
                    groups[entry][1] += 1
                    groups[entry][2] = min(groups[entry][2], rank)
                out.append(groups[entry])
            first = [g[0] == i for i, g in enumerate(out)]
            best = [g[2] if f else None for g, f in zip(out, first, strict=True)]
            columns = [
                pa.array(range(uid, uid + len(out)), pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([g[4] for g in out], pa.int64()),
                pa.array([g[3] for g in out], pa.binary()),
                pa.array([g[5] for g in out], pa.int64()),
                pa.array(first, pa.bool_()),
                pa.array([g[1] if f else None for g, f in zip(out, first, strict=True)], pa.int64()),
                pa.array([b and -b[0] for b in best], pa.int64()),
                pa.array([None if b is None or b[1] else b[2] for b in best], pa.int64()),
                pa.array([b and b[3] for b in best], pa.int64()),
                rows,
            ]
            uid += len(out)
            yield pa.RecordBatch.from_arrays(columns, [*[c.split()[0] for c in FOLDED.split(", ")], "row"])

    return fold


def buckets(firsts: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> Column:
    """The bucket of a row: hashed once, and again at every level at which its bucket is too large.

    The driver sees one total and the numbers of oversized buckets.  A bucket of a single hash
    isn't split: the table holds each content once.
    """
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    width = max(1, math.ceil(total / bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(0), "hash"), F.lit(width)).cast("string")
    level = 0
    while True:
        sizes = firsts.groupBy(bucket.alias("b")).agg(
            F.sum("n_bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        large = [r.b for r in sizes.where((F.col("bytes") > 2 * bucket_bytes) & (F.col("low") < F.col("high"))).collect()]
        if not large:
            return bucket
        level += 1
        again = F.pmod(F.xxhash64(F.lit(level), "hash"), F.lit(fan)).cast("string")
        bucket = F.when(bucket.isin(large), F.concat(bucket, F.lit("/"), again)).otherwise(bucket)


def _classes(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: a row for every distinct content."""
    found = ContentTable()
    groups: list[list] = []
    for batch in batches:
        for row, raw in zip(batch.drop_columns(["text"]).to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            entry = found.put(row["hash"], normalised(raw))
            rank = _rank(row["keep_chars"], row["keep_id"], row["keep_uid"])
            if entry == len(groups):
                groups.append([row["sha256"], rank, row["n"]])
            else:
                groups[entry][1] = min(groups[entry][1], rank)
                groups[entry][2] += row["n"]
    columns = [
        pa.array([g[0] for g in groups], pa.binary()),
        pa.array([g[1][3] for g in groups], pa.int64()),
        pa.array([None if g[1][1] else g[1][2] for g in groups], pa.int64()),
        pa.array([g[2] for g in groups], pa.int64()),
    ]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CLASSES.split(", ")])


def exact_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Every row of ``docs`` with the copy that stays for it.

    Texts are equal when identical without the characters of ``BLANKS``; null counts as empty, and
    empty texts are copies of each other.  Of equal texts the row with the most code points stays,
    then the smallest doc_id (null last), then the first one read, so of repeated rows one stays.
    Columns: ``row`` (all of ``docs``, whatever their names), doc_id, keep_id, group_size, kept,
    text_sha256 (of the normalised text).  An empty table gives an empty one.
    """
    kind = docs.select(whole_row(docs).alias("row"))
    folded = kind.mapInArrow(_fold(text, doc_id), schema(FOLDED, row=kind.schema["row"].dataType))
    folded = materialize(folded, "folded")
    firsts = folded.where("first")
    dealt = firsts.select(
        buckets(firsts, bucket_bytes).alias("bucket"),
        "hash", "sha256", "n", "keep_chars", "keep_id", "keep_uid",
        F.col("row").getField(text).alias("text"),
    )
    # What the buckets return is narrow and small; it is written so that no later step deals texts again.
    classes = materialize(dealt.groupBy("bucket").applyInArrow(_classes, CLASSES), "classes")
    joined = folded.join(classes.withColumnRenamed("keep_id", "_keep").withColumnRenamed("keep_uid", "_stays"), "sha256")
    return joined.select(
        "row",
        "doc_id",
        F.col("_keep").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("_stays")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that another copy stays for; its columns as they were."""
    kept = exact_copies(docs, text, doc_id).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
