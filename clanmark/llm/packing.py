"""Hierarchical residual packing of token pieces into sequences of bounded length.

Tasks pack their own pieces best-fit, longest first, and set nearly full bins aside.  The bins that
remain are items of the next round, in fewer and larger groups, until one group, or as few groups as
hold ``task_items`` each, has been packed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clanmark.llm.base import col, strings
from clanmark.llm.word_tokens import WORD_BPE, encoder
from clanmark.llm.words import byte_slices, gathered
from clanmark.sources.workspace import materialize, release

CAPACITY = 2048
END_ID = 0
#: A bin with at most this part of the capacity free is not opened again.
FREE = 0.005
FAN = 4
TASK_ITEMS = 250_000
SLICE_BYTES = 4 << 20

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "members array<long>, sizes array<int>, fill int"


def _cut_pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    """The pieces of every document: its ids and ``end_id``, cut only where they exceed the capacity."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, texts in byte_slices(strings(batch.column("text")), SLICE_BYTES):
                ids, offsets = encoder(path, special=True).encode(texts)
                rows, blobs = [], []
                for i in range(len(texts)):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], end_id).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        raw = own[start : start + capacity].tobytes()
                        rows.append((uid, doc_ids[first + i], piece, start, len(raw) // 4, zlib.crc32(raw)))
                        uid += 1
                        if with_ids:
                            blobs.append(raw)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [c.split()[0] for c in PIECES.split(", ")]
                if with_ids:
                    columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return pieces


def token_pieces(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    path: str = WORD_BPE,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece of every document (null text: empty, which is one piece of ``end_id`` alone).

    Exact strings of the tokenizer's special tokens in a text are these tokens.

    Columns: uid, doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32,
    and with ``with_ids`` the little-endian unsigned 32-bit ids.
    """
    kind = PIECES + (", ids binary" if with_ids else "")
    own = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return own.mapInArrow(_cut_pieces(path, capacity, end_id, with_ids), kind)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, longest first into the bin with the least room that takes it; the bins used."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # the rooms that some bin has, as bits
    place = np.zeros(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, bins
            bins += 1
        place[i] = chosen
        if room > size:
            by_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return place, bins


def _pack(capacity: int):
    """One round of one task: its bins merged best-fit; a bin is never opened, only joined to others."""

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        members, sizes = (table.column(c).combine_chunks() for c in ("members", "sizes"))
        fill = table.column("fill").to_numpy()
        at = members.offsets.to_numpy().astype(np.int64)
        place, bins = best_fit(fill, capacity)
        order = np.argsort(place, kind="stable")
        lengths = np.diff(at)
        flat_members, flat_sizes = members.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy(zero_copy_only=False)
        counts = np.bincount(place, weights=lengths, minlength=bins).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        columns = [
            pa.ListArray.from_arrays(ends, pa.array(gathered(order, at[:-1], lengths, flat_members), pa.int64())),
            pa.ListArray.from_arrays(ends, pa.array(gathered(order, at[:-1], lengths, flat_sizes), pa.int32())),
            pa.array(np.bincount(place, weights=fill, minlength=bins).astype(np.int32), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["members", "sizes", "fill"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TASK_ITEMS:
                yield merged(held)
                held, rows = [], 0
        if rows:
            yield merged(held)

    return pack


def pack_bins(pieces: DataFrame, capacity: int = CAPACITY, task_items: int = TASK_ITEMS) -> DataFrame:
    """(members, sizes, fill): bins of the pieces' uids, each within the capacity.

    Driver state: one count per round.  A round has a quarter of the groups of the one before, but
    never more than ``task_items`` items in a group, and rounds end when there is one group or a
    round at the least number of groups saves less than one bin in a thousand.
    """
    items = pieces.where(F.col("length") < capacity).select(
        F.array("uid").alias("members"), F.array(F.col("length").cast("int")).alias("sizes"), F.col("length").cast("int").alias("fill")
    )
    done = [
        pieces.where(F.col("length") >= capacity).select(
            F.array("uid").alias("members"), F.array(F.col("length").cast("int")).alias("sizes"), F.col("length").cast("int").alias("fill")
        )
    ]
    full = int(capacity * (1 - FREE))
    bins = materialize(items.mapInArrow(_pack(capacity), BINS), "bins")
    parts = max(1, bins.rdd.getNumPartitions()) * FAN
    last = None
    while True:
        done.append(bins.where(F.col("fill") >= full))
        rest = bins.where(F.col("fill") < full)
        count = rest.count()
        least = max(1, math.ceil(count / task_items))
        settled = parts <= least and (least == 1 or (last is not None and count > 0.999 * last))
        if count < 2 or settled:
            done.append(rest)
            break
        parts, last = max(least, math.ceil(parts / FAN)), count
        bins = materialize(rest.repartition(parts).mapInArrow(_pack(capacity), BINS), "bins")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = WORD_BPE, capacity: int = CAPACITY
) -> DataFrame:
    """Where each piece of every document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than ``capacity`` are cut into pieces of it, the last one shorter.  The pieces of
    a sequence lie one after the other from 0.  Repeated rows are packed once each; null and empty
    texts are one token; an empty table gives an empty one.
    """
    pieces = materialize(token_pieces(docs, text, doc_id, path, capacity), "pieces")
    bins = materialize(pack_bins(pieces, capacity), "packed")
    ends = F.aggregate(
        "sizes",
        F.array(F.lit(0).cast("long")),
        lambda done, size: F.concat(done, F.array(F.element_at(done, -1) + size)),
    )
    placed = (
        bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members", ends.alias("ends"))
        .select("sequence_id", F.explode(F.arrays_zip(F.col("members"), F.slice("ends", F.lit(1), F.size("members")).alias("ends"))).alias("m"))
        .select("sequence_id", F.col("m.members").alias("uid"), F.col("m.ends").alias("offset"))
    )
    out = pieces.join(placed, "uid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
