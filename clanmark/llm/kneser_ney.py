"""Interpolated modified Kneser-Ney model: counted by Spark, kept as sorted arrays, memory-mapped.

Words are 64-bit hashes.  A word's id is its place in the sorted array of all hashes, which is cut
into shards by leading bits; n-grams lie in the shard of their context, sorted by context and last word:
each context stands there once, and an n-gram takes the id of its last word and a byte of count.  The
context of a bigram is an id, that of longer n-grams, up to the model's order, a hash of ids.  What is
known of a context is summed up from its n-grams, and kept only where these are many.  Below the highest
order, an n-gram counts the words that stand before it, or keeps its
count if it starts with a beginning of a text.  Tasks write the shards as files into the shared folder of ``spark.checkpoint.dir``, and
the tasks that score documents map those files: no model is copied to executors or the driver.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.llm.base import col, strings
from clanmark.llm.words import byte_slices, mixed, word_hashes
from clanmark.sources.workspace import fresh_path, materialize, release

#: Words of the longest n-grams of the registered query.
ORDER = 3
#: The token after the last word of every text.
END = np.uint64(0x5BD1E9955BD1E995)
SLICE_BYTES = 12 << 20
#: Texts whose longer n-grams a task counts or scores at once.
GRAM_BYTES = 4 << 20
#: A context with more than this part of a shard's tokens is hot: its bigrams are dealt over all shards.
HOT = 0.25
#: N-grams that a task sorts or packs at once.
PART = 1 << 18
#: Contexts with more n-grams than this keep their statistics beside them.
WIDE = 16
#: Contexts whose places in the array of n-grams are told from one common place.
BLOCK = 64
#: A file with so many contexts or more keeps 6 of the 8 bytes of a hash; where the first two change is in an index.
CUT = 1 << 19
#: Spark's setting for shuffle files that go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOW = np.uint64(0xFFFFFFFF)


def mounted(path: str) -> str:
    """The path of a folder that all executors mount; other stores can't be memory-mapped."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"model files need a mounted folder in spark.checkpoint.dir, not {parts.scheme}:")
    return parts.path


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    """Arrays one after the other in one file, which appears whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    head = np.array([x for a in arrays.values() for x in (len(a), a.dtype.itemsize)], dtype="<i8")
    with open(part, "wb") as out:
        out.write(head.tobytes())
        for a in arrays.values():
            a.tofile(out)
            out.write(b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def map_arrays(path: str, *kinds: str) -> list[np.ndarray]:
    """The arrays of a file of ``write_arrays``, memory-mapped; of kind "u": unsigned, as wide as they are."""
    data = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    head = data[: 16 * len(kinds)].view("<i8")
    out, at = [], 16 * len(kinds)
    for i, kind in enumerate(kinds):
        size = int(head[2 * i]) * int(head[2 * i + 1])
        out.append(data[at : at + size].view(f"<u{int(head[2 * i + 1])}" if kind == "u" else kind))
        at += size + -size % 8
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, each with the sum of its counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _run_stats(counts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each run of n-grams: the sum of counts, and how many are 1, 2, and 3 or more."""
    edges = np.stack([begin, end], 1).reshape(-1)
    if not len(edges):
        return np.zeros((0, 4), np.int64)
    parts = counts, counts == 1, counts == 2, counts > 2
    return np.stack([np.add.reduceat(np.append(x, x.dtype.type(0)), edges, dtype=np.int64)[::2] for x in parts], 1)


def write_runs(path: str, heads: np.ndarray, first: np.ndarray, own: np.ndarray, counts: np.ndarray) -> None:
    """A file of n-grams sorted by context and last word: the distinct contexts, and where the n-grams of each begin."""
    starts = np.append(first, len(own))
    blocks = starts[::BLOCK]
    places = starts - np.repeat(blocks, BLOCK)[: len(starts)]
    index, high = np.zeros(0, "<u4"), np.zeros(0, "<u2")
    if heads.dtype.itemsize == 8 and len(heads) >= CUT:
        index = np.searchsorted(heads, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        index = np.append(index, len(heads)).astype("<u4")
        heads, high = (heads & _LOW).astype("<u4"), (heads >> np.uint64(32) & np.uint64(0xFFFF)).astype("<u2")
    large, wide = np.flatnonzero(counts > 254), np.flatnonzero(np.diff(starts) > WIDE)
    write_arrays(
        path,
        index=index,
        high=high,
        heads=heads,
        blocks=blocks.astype("<i8"),
        places=places.astype("<u2" if places.max() < 1 << 16 else "<u4"),
        own=own.astype("<u4"),
        counts=np.minimum(counts, 255).astype(np.uint8),
        large=large.astype("<i8"),
        large_counts=counts[large].astype("<i8"),
        wide=wide.astype("<i8"),
        wide_stats=_run_stats(counts, starts[wide], starts[wide + 1]).astype("<i8").reshape(-1),
    )


def _lower(get, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place of each range whose entry isn't below what is wanted there (the range's end: none)."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    left = np.flatnonzero(low < high)
    while len(left):
        middle = (low[left] + high[left]) >> 1
        less = get(middle) < wanted[left]
        low[left] = np.where(less, middle + 1, low[left])
        high[left] = np.where(less, high[left], middle)
        left = left[low[left] < high[left]]
    return low


class Runs:
    """A file of ``write_runs``, memory-mapped."""

    def __init__(self, path: str):
        kinds = "<u4", "<u2", "u", "<i8", "u", "<u4", "u1", "<i8", "<i8", "<i8", "<i8"
        self.index, self.high, self.heads, self.blocks, self.places, self.own, *rest = map_arrays(path, *kinds)
        self.small, self.large, self.large_counts, self.wide, self.wide_stats = rest

    def _contexts(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each context, and which are there."""
        if not len(self.index):
            at = np.searchsorted(self.heads, heads.astype(self.heads.dtype))
            here = np.minimum(at, len(self.heads) - 1)
            return at, self.heads[here] == heads
        first = (heads >> np.uint64(48)).astype(np.int64)
        rest, end = heads & np.uint64((1 << 48) - 1), self.index[first + 1]

        def get(i: np.ndarray) -> np.ndarray:
            return self.high[i].astype(np.uint64) << np.uint64(32) | self.heads[i]

        at = _lower(get, self.index[first], end, rest)
        return at, (at < end) & (get(np.minimum(at, len(self.heads) - 1)) == rest)

    def _starts(self, contexts: np.ndarray) -> np.ndarray:
        return self.blocks[contexts // BLOCK] + self.places[contexts]

    def _counts(self, places: np.ndarray) -> np.ndarray:
        counts = self.small[places].astype(np.int64)
        over = np.flatnonzero(counts == 255)
        counts[over] = self.large_counts[np.searchsorted(self.large, places[over])]
        return counts

    def look(self, heads: np.ndarray, own: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each n-gram, and the statistics of its context where they are wanted (``plain``)."""
        counts, stats = np.zeros(len(heads), np.int64), np.zeros((len(heads), 4), np.int64)
        at, hit = self._contexts(heads)
        found, at = np.flatnonzero(hit), at[hit]
        begin, end = self._starts(at), self._starts(at + 1)
        place = _lower(lambda i: self.own[i], begin, end, own[found])
        there = (place < end) & (self.own[np.minimum(place, len(self.own) - 1)] == own[found])
        counts[found[there]] = self._counts(place[there])
        size = np.where(plain[found], end - begin, 0)
        many = np.flatnonzero(size > WIDE)
        stats[found[many]] = self.wide_stats.reshape(-1, 4)[np.searchsorted(self.wide, at[many])]
        left = np.flatnonzero((size > 0) & (size <= WIDE))
        for k in range(WIDE):
            c = self._counts(begin[left] + k)
            stats[found[left], 0] += c
            stats[found[left], _classes(c)] += 1
            left = left[size[left] > k + 1]
        return counts, stats


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an END after each text's words, and where each text's tokens begin."""
    hashes, offsets = word_hashes(texts)
    out = np.insert(hashes, offsets[1:], END)
    return out, offsets + np.arange(len(offsets))


@dataclass
class Words:
    """The vocabulary: shards by the leading ``bits`` of the hash, and how many words lie before each."""

    folder: str
    bits: int
    bases: np.ndarray
    total: int = 0
    size: int = 0
    open: dict[int, list[np.ndarray]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def shard(self, s: int) -> list[np.ndarray]:
        if s not in self.open:
            self.open[s] = map_arrays(f"{self.folder}/words-{s}", "<u8", "<i8")
        return self.open[s]

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, ids, "right") - 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each of some sorted distinct hashes (-1: not in the vocabulary), and its count."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(hashes, leading(np.arange(1, 1 << self.bits), self.bits))
        edges = np.concatenate([[0], edges, [len(hashes)]])
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if self.bases[s + 1] == self.bases[s]:
                continue
            known, times = self.shard(s)
            own = hashes[edges[s] : edges[s + 1]]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            ids[edges[s] : edges[s + 1]][hit] = at[hit] + self.bases[s]
            counts[edges[s] : edges[s + 1]][hit] = times[at[hit]]
        return ids, counts


def leading(shards: np.ndarray, bits: int) -> np.ndarray:
    """The least hash of each shard."""
    return shards.astype(np.uint64) << np.uint64(64 - bits) if bits else shards.astype(np.uint64)


def _packed(a: np.ndarray) -> bytes:
    """The array's bytes compressed, the first of every row before the second ones: of sorted rows most are alike."""
    rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.uint8)
    return np.array(rows.shape, dtype="<i8").tobytes() + pa.compress(rows.T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    n, width = np.frombuffer(blob[:16], "<i8").tolist()
    flat = pa.decompress(blob[16:], n * width, codec="zstd", asbytes=True)
    return np.frombuffer(flat, np.uint8).reshape(width, n).T.tobytes()


def _blobs(shard: list[int], *parts: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(shard, pa.int32()), *[pa.array([_packed(a) for a in p], pa.binary()) for p in parts]]
    return pa.RecordBatch.from_arrays(columns, ["shard", *["keys", "counts"][: len(parts)]])


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in byte_slices(strings(batch.column("text")), SLICE_BYTES):
                keys, counts = np.unique(tokens(texts)[0], return_counts=True)
                edges = np.searchsorted(keys, leading(np.arange(1, 1 << bits), bits))
                edges = np.concatenate([[0], edges, [len(keys)]]).astype(int)
                full = np.flatnonzero(np.diff(edges)).tolist()
                cut = [slice(edges[s], edges[s + 1]) for s in full]
                yield _blobs(full, [keys[c] for c in cut], [counts[c].astype("<u4") for c in cut])

    return run


def _all_unpacked(blobs: pa.ChunkedArray, kind: str) -> np.ndarray:
    blobs = [b.as_buffer() for b in blobs]
    shapes = [np.frombuffer(b, "<i8", 2).tolist() for b in blobs]
    out, at = np.empty(sum(n * width for n, width in shapes), np.uint8), 0
    for b, (n, width) in zip(blobs, shapes, strict=True):
        flat = pa.decompress(b.slice(16), n * width, codec="zstd")
        out[at : at + n * width].reshape(n, width)[:] = np.frombuffer(flat, np.uint8).reshape(width, n).T
        at += n * width
    return out.view(kind)


def _joined(group: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return _all_unpacked(group.column("keys"), kind), _all_unpacked(group.column("counts"), "<u4").astype(np.int64)


def _keep_words(folder: str):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = summed(*_joined(group, "<u8"))
        write_arrays(f"{folder}/words-{shard}", keys=keys, counts=counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())], "most": [int(counts.max())]})

    return run


def _pairs(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: the id of its context (``words.size``: the beginning), its own id, its count; offsets."""
    hashes, offsets = tokens(texts)
    distinct, place = np.unique(hashes, return_inverse=True)
    ids, counts = words.find(distinct)
    own = ids[place]
    context = np.concatenate([[0], own[:-1]])
    context[offsets[:-1]] = words.size
    return context, own, counts[place], offsets


def _grams(words: Words, context: np.ndarray, own: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Of every token: its id and those of the ``order`` - 1 tokens before it, the last first."""
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(own)) - begin
    found = [own, context]
    for back in range(2, order):
        found.append(np.where(place >= back, own[np.maximum(np.arange(len(own)) - back, 0)], words.size))
    return found


def _gram_keys(words: Words, hot: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each n-gram and of its context, the n-gram's shard, and whether that isn't its context's.

    A context of hot words and beginnings alone may be hot itself: its n-grams are dealt by their hash.
    """
    head = np.full(len(grams[0]), len(grams), dtype=np.uint64)
    dealt = np.ones(len(head), dtype=bool)
    for ids in grams[1:]:
        head = mixed(head * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64))
        dealt &= (ids >= words.size) | np.isin(ids, hot)
    keys = mixed(head * np.uint64(0x9E3779B97F4A7C15) + grams[0].astype(np.uint64))
    return keys, head, (np.where(dealt, keys, head) % np.uint64(1 << words.bits)).astype(np.int64), dealt


def _columns(ids: np.ndarray) -> list[np.ndarray]:
    return [ids[:, i].astype(np.int64) for i in range(ids.shape[1])]


def _gram_home(words: Words, hot: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    if len(grams) > 2:
        return _gram_keys(words, hot, grams)[2]
    return _home(words, hot, grams[1], grams[1].astype(np.uint64) << np.uint64(32) | grams[0].astype(np.uint64))


def _gram_blobs(words: Words, hot: np.ndarray, grams: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    """N-grams as ids of 32 bits, the last word first, by shard; two of them are the key of a bigram."""
    home = _gram_home(words, hot, grams)
    order = np.lexsort((*grams, home))  # in order, they take little room
    ids = np.stack([g[order].astype("<u4") for g in grams], 1)
    counts = counts[order].astype("<u4")
    edges = np.searchsorted(home[order], np.arange((1 << words.bits) + 1))
    full = np.flatnonzero(np.diff(edges)).tolist()
    return _blobs(full, [ids[edges[s] : edges[s + 1]] for s in full], [counts[edges[s] : edges[s + 1]] for s in full])


def _count_grams(words: Words, hot: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in byte_slices(strings(batch.column("text")), GRAM_BYTES):
                context, own, _, offsets = _pairs(words, texts)
                grams = _grams(words, context, own, offsets, order)
                _, at, counts = np.unique(_gram_keys(words, hot, grams)[0], return_index=True, return_counts=True)
                yield _gram_blobs(words, hot, [g[at] for g in grams], counts)

    return run


def _parts(n: int) -> list[slice]:
    return [slice(first, first + PART) for first in range(0, n, PART)]


def _merged(heads: np.ndarray, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct n-gram, in order of context and last word, and the sum of its counts."""
    bits = np.uint64(max(0, math.ceil(math.log2(max(1, len(heads) / PART)))))
    places, sums = [], []
    for leads in range(1 << int(bits)):
        some = np.flatnonzero(heads >> (np.uint64(64) - bits) == leads) if bits else np.arange(len(heads))
        if not len(some):
            continue
        some = some[np.argsort(heads[some])]
        place = np.cumsum(np.append(False, heads[some[1:]] != heads[some[:-1]])).astype(np.uint64) << np.uint64(32) | own[some]
        by = np.argsort(place)
        first = np.flatnonzero(np.append(True, np.diff(place[by]) != 0))
        places.append(some[by[first]])
        sums.append(np.add.reduceat(counts[some[by]], first))
    return np.concatenate(places), np.concatenate(sums)


def _keep_grams(words: Words, hot: np.ndarray, order: int):
    """A shard of n-grams and its contexts; returned: the shorter n-grams, what is known of contexts that
    may be hot (numbers from -1 - shards down), and counts of counts (numbers from -1 down)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, shards = key[0].as_py(), 1 << words.bits
        ids, counts = _joined(group, "<u4")
        ids = ids.reshape(-1, order)
        heads, dealt = np.empty(len(ids), np.uint64), np.empty(len(ids), bool)
        for part in _parts(len(ids)):
            _, heads[part], _, dealt[part] = _gram_keys(words, hot, _columns(ids[part]))
        at, counts = _merged(heads, ids[:, 0], counts)
        ids, heads, dealt = ids[at], heads[at], dealt[at]
        first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        known = heads[first]
        del at, heads
        write_runs(f"{words.folder}/grams{order}-{shard}", known, first, ids[:, 0], counts)
        spread = np.flatnonzero(dealt[first])
        known, stats = known[spread], _run_stats(counts, first[spread], np.append(first, len(ids))[spread + 1]).astype("<u4")
        told = np.array([int((counts == k).sum()) for k in (1, 2, 3, 4)], dtype="<i8")
        ids = ids[:, :-1]
        counts = np.where(ids[:, -1] >= words.size, counts, 1)
        home = np.empty(len(ids), np.int32)
        for part in _parts(len(ids)):
            home[part] = _gram_home(words, hot, _columns(ids[part]))
        step = max(1, shards * PART // max(1, len(ids)))
        blobs = []
        for s in range(0, shards, step):
            some = np.flatnonzero((home >= s) & (home < s + step))
            blobs.append(_gram_blobs(words, hot, _columns(ids[some]), counts[some]))
        home = (known % np.uint64(shards)).astype(np.int64)
        full = np.unique(home).tolist()
        blobs.append(_blobs([-1 - shards - s for s in full], [known[home == s] for s in full], [stats[home == s] for s in full]))
        blobs.append(_blobs([-1 - shard], [told], [np.zeros(0, "<u4")]))
        return pa.Table.from_batches(blobs)

    return run


def _keep_hot_contexts(words: Words, order: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = -1 - (1 << words.bits) - key[0].as_py()
        heads, flat = _joined(group, "<u8")
        known, place = np.unique(heads, return_inverse=True)
        stats = [np.bincount(place, weights=c, minlength=len(known)) for c in flat.reshape(-1, 4).T]
        write_arrays(f"{words.folder}/hot{order}-{shard}", known=known, stats=np.stack(stats, 1).reshape(-1).astype("<i8"))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def _home(words: Words, hot: np.ndarray, context: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The shard of each bigram: that of its context, or any by hash if the context is hot."""
    n = 1 << words.bits
    home = np.where(context >= words.size, -1, words.shard_of(np.minimum(context, max(0, words.size - 1))))
    dealt = (home < 0) | np.isin(context, hot)
    return np.where(dealt, (mixed(keys) % np.uint64(n)).astype(np.int64), home)


def _count_pairs(words: Words, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in byte_slices(strings(batch.column("text")), SLICE_BYTES):
                context, own, _, _ = _pairs(words, texts)
                keys, counts = np.unique(context.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64), return_counts=True)
                home = _home(words, hot, (keys >> np.uint64(32)).astype(np.int64), keys)
                order = np.argsort(home, kind="stable")
                edges = np.searchsorted(home[order], np.arange((1 << words.bits) + 1))
                full = np.flatnonzero(np.diff(edges)).tolist()
                cut = [order[edges[s] : edges[s + 1]] for s in full]
                yield _blobs(full, [keys[c] for c in cut], [counts[c].astype("<u4") for c in cut])

    return run


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 3)


def _keep_pairs(words: Words, hot: np.ndarray):
    """A shard of bigrams and the statistics of its contexts; returned: how many left contexts its words have."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = summed(*_joined(group, "<u8"))
        context, own = (keys >> np.uint64(32)).astype(np.int64), (keys & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, np.diff(context) != 0))
        known = context[first]
        write_runs(f"{words.folder}/pairs-{shard}", known.astype("<u4"), first, own, counts)
        spread = np.flatnonzero((known >= words.size) | np.isin(known, hot))
        stats = _run_stats(counts, first[spread], np.append(first, len(own))[spread + 1])
        rows = np.hstack([known[spread, None], stats])
        found = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        seen, times = np.unique(own, return_counts=True)
        home = words.shard_of(seen)
        edges = np.searchsorted(home, np.arange((1 << words.bits) + 1))
        full = np.flatnonzero(np.diff(edges)).tolist()
        blobs = _blobs(full, [seen[edges[s] : edges[s + 1]].astype("<u4") for s in full], [times[edges[s] : edges[s + 1]].astype("<u4") for s in full])
        told = np.array([*found, len(keys), *rows.reshape(-1).tolist()], dtype="<i8")
        # Statistics for the driver stand in a row of their own, with a negative number.
        return pa.Table.from_batches([blobs, _blobs([-1 - shard], [told], [np.zeros(0, "<u4")])])

    return run


def _keep_continuations(words: Words):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        base, n = int(words.bases[shard]), int(words.bases[shard + 1] - words.bases[shard])
        ids, times = _joined(group, "<u4")
        counts = np.bincount(ids.astype(np.int64) - base, weights=times, minlength=n).astype("<i8")
        write_arrays(f"{words.folder}/lefts-{shard}", lefts=counts)
        found = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"shard": pa.array([shard], pa.int32()), **{f"n{k}": [x] for k, x in enumerate(found, 1)}, "more": [int((counts >= 3).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2, and 3 or more (Chen and Goodman); where too few counts tell, half of the count's least."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    above = ((n1, n2), (n2, n3), (n3, n4))
    found = [k - (k + 1) * y * b / a if a and b else 0.5 for k, (a, b) in enumerate(above, 1)]
    return np.array([0.0, *[min(max(d, 0.0), k - 0.01) for k, d in enumerate(found, 1)]])


@dataclass
class Model:
    """What is broadcast: paths, a number per shard, and the statistics of hot contexts (a few per shard)."""

    words: Words
    hot: dict[int, tuple[int, int, int, int]]
    pair_discounts: np.ndarray
    left_discounts: np.ndarray
    lefts: int = 0
    left_mass: float = 0.0
    hot_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gram_discounts: dict[int, np.ndarray] = field(default_factory=dict)  # of each order above 2
    open: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def runs(self, name: str) -> Runs | None:
        if name not in self.open:
            path = f"{self.words.folder}/{name}"
            self.open[name] = Runs(path) if os.path.exists(path) else None
        return self.open[name]

    def file(self, name: str, *kinds: str) -> list[np.ndarray] | None:
        if name not in self.open:
            path = f"{self.words.folder}/{name}"
            self.open[name] = map_arrays(path, *kinds) if os.path.exists(path) else None
        return self.open[name]

    def _unigrams(self, ids: np.ndarray) -> np.ndarray:
        """P(w) from how many contexts a word follows, interpolated with one part of V + 1 for each word
        and for all unknown words together."""
        out = np.full(len(ids), self.left_mass / (self.words.size + 1))
        for s, at in self._by_shard(self.words.shard_of(ids), ids >= 0):
            counts = self.file(f"lefts-{s}", "<i8")[0][ids[at] - self.words.bases[s]]
            out[at] += (counts - self.left_discounts[_classes(counts)]) / self.lefts
        return out

    @staticmethod
    def _by_shard(shard: np.ndarray, use: np.ndarray):
        """Places of each shard: those that ``use`` is true for, or holds, in its order."""
        at = np.flatnonzero(use) if use.dtype == bool else use
        at = at[np.argsort(shard[at], kind="stable")]
        edges = np.flatnonzero(np.diff(shard[at])) + 1
        for part in np.split(at, edges):
            if len(part):
                yield int(shard[part[0]]), part

    def probabilities(self, context: np.ndarray, own: np.ndarray) -> np.ndarray:
        """P(own | context) of distinct pairs of ids, sorted; -1 is an unknown word."""
        words, lower = np.unique(own, return_inverse=True)
        lower = self._unigrams(words)[lower]
        total, counts, mass = np.zeros(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own))
        kinds = self.pair_discounts[1:]
        for c, (n, *classes) in self.hot.items():
            low, high = np.searchsorted(context, [c, c + 1])
            total[low:high], mass[low:high] = n, float(np.dot(kinds, classes))
        hot = np.array(sorted(self.hot), dtype=np.int64)
        plain = (context >= 0) & (context < self.words.size) & ~np.isin(context, hot)
        keys = np.maximum(context, 0).astype(np.uint64) << np.uint64(32) | np.maximum(own, 0).astype(np.uint64)
        for s, at in self._by_shard(_home(self.words, hot, context, keys), context >= 0):
            if (held := self.runs(f"pairs-{s}")) is not None:
                counts[at], rows = held.look(context[at], own[at], plain[at])
                some = plain[at]
                total[at[some]], mass[at[some]] = rows[some, 0], rows[some, 1:] @ kinds
        higher = np.maximum(counts - self.pair_discounts[_classes(counts)], 0.0)
        safe = np.where(total > 0, total, 1.0)
        return np.where(total > 0, (higher + mass * lower) / safe, lower)


def _raised(know: Model, grams: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
    """P(token | the tokens before it) in the order of ``grams``, from that in the order below."""
    words, order = know.words, len(grams)
    kinds = know.gram_discounts[order]
    keys, heads, home, dealt = _gram_keys(words, know.hot_words, grams)
    known = np.logical_and.reduce([g >= 0 for g in grams[1:]])
    total, counts, mass = np.zeros(len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys))

    sought = np.flatnonzero(known)
    for s, at in know._by_shard(home, sought[np.argsort(heads[sought])]):  # in the order of the file
        if (held := know.runs(f"grams{order}-{s}")) is not None:
            counts[at], rows = held.look(heads[at], grams[0][at], ~dealt[at])
            total[at], mass[at] = rows[:, 0], rows[:, 1:] @ kinds[1:]
    for s, at in know._by_shard((heads % np.uint64(1 << words.bits)).astype(np.int64), known & dealt):
        if (held := know.file(f"hot{order}-{s}", "<u8", "<i8")) is not None:
            held, stats = held
            place = np.minimum(np.searchsorted(held, heads[at]), len(held) - 1)
            hit = held[place] == heads[at]
            rows = stats.reshape(-1, 4)[place[hit]]
            total[at[hit]], mass[at[hit]] = rows[:, 0], rows[:, 1:] @ kinds[1:]
    higher = np.maximum(counts - kinds[_classes(counts)], 0.0)
    return np.where(total > 0, (higher + mass * lower) / np.where(total > 0, total, 1.0), lower)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know: Model = model.value
        words = know.words
        for batch in batches:
            for first, texts in byte_slices(strings(batch.column("text")), GRAM_BYTES if know.gram_discounts else SLICE_BYTES):
                context, own, counts, offsets = _pairs(words, texts)
                keys = (context + 1).astype(np.uint64) << np.uint64(32) | (own + 1).astype(np.uint64)
                distinct, place = np.unique(keys, return_inverse=True)
                pair = (distinct >> np.uint64(32)).astype(np.int64) - 1, (distinct & _LOW).astype(np.int64) - 1
                likely = know.probabilities(*pair)[place]
                if know.gram_discounts:
                    grams = _grams(words, context, own, offsets, max(know.gram_discounts))
                    for order in sorted(know.gram_discounts):
                        likely = _raised(know, grams[:order], likely)
                logs = np.log10(likely)
                base = np.log10((counts + 0.5) / (words.total + 0.5 * (words.size + 1)))
                sums = [np.add.reduceat(x, offsets[:-1]) for x in (base, logs, (counts > 0).astype(np.int64))]
                columns = [
                    *[c.slice(first, len(texts)) for c in batch.drop_columns(["text"]).columns],
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(sums[2], pa.int64()),
                    pa.array(np.full(len(texts), words.total), pa.int64()),
                    pa.array(sums[0], pa.float64()),
                    pa.array(sums[1], pa.float64()),
                ]
                names = [*batch.drop_columns(["text"]).schema.names, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


@contextmanager
def _without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their execution: none of those within is run twice."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def train(texts: DataFrame, order: int = 2) -> Model:
    """The model of all rows of (text), of n-grams of up to ``order`` words (2 at least).

    Two passes over the rows; each shorter n-gram is counted from the n-grams a word longer.  Shuffles and
    tables of counts go as soon as what was counted from them is written; the model's files stay.

    Shards grow in number with the partitions of the input.  The driver gets a row per shard, and a row
    per shard and hot context; contexts are hot by their share, so their number is bounded by shards.
    """
    if order < 2:
        raise ValueError("the order must be 2 at least")
    with _without_old_shuffles(texts.sparkSession):
        return _train(texts, order)


def _train(texts: DataFrame, order: int) -> Model:
    spark: SparkSession = texts.sparkSession
    folder = mounted(fresh_path(spark, "kneser-ney"))
    bits = max(0, math.ceil(math.log2(max(1, texts.rdd.getNumPartitions()))))
    blobs = "shard int, keys binary, counts binary"
    counted = texts.mapInArrow(_count_words(bits), blobs).groupBy("shard")
    kept = counted.applyInArrow(_keep_words(folder), "shard int, n long, tokens long, most long").collect()
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for row in kept:
        sizes[row.shard] = row.n
    words = Words(folder, bits, np.concatenate([[0], np.cumsum(sizes)]), sum(r.tokens for r in kept), int(sizes.sum()))
    if words.size >= (1 << 32) - 2:
        raise ValueError("more than 2**32 words")
    hot = _hot_words(words, [r.shard for r in kept if r.most > HOT * words.total / (1 << bits)])

    gram_discounts, longer = {}, None
    grams = texts.mapInArrow(_count_grams(words, hot, order) if order > 2 else _count_pairs(words, hot), blobs)
    for n in range(order, 2, -1):
        kept = materialize(grams.groupBy("shard").applyInArrow(_keep_grams(words, hot, n), blobs), f"grams{n}")
        release(longer)
        seen = np.zeros(4, dtype=np.int64)
        for row in kept.where((F.col("shard") < 0) & (F.col("shard") >= -(1 << bits))).select("keys").collect():
            seen += np.frombuffer(_unpacked(row["keys"]), "<i8")
        gram_discounts[n] = discounts(*seen.tolist())
        hot_contexts = kept.where(F.col("shard") < -(1 << bits)).groupBy("shard")
        hot_contexts.applyInArrow(_keep_hot_contexts(words, n), "shard int").count()
        grams, longer = kept.where("shard >= 0"), kept
    told = materialize(grams.groupBy("shard").applyInArrow(_keep_pairs(words, hot), blobs), "lefts")
    release(longer)
    found, spread = np.zeros(5, dtype=np.int64), {}
    for row in told.where("shard < 0").select("keys").collect():
        numbers = np.frombuffer(_unpacked(row["keys"]), "<i8")
        found += numbers[:5]
        for c, *stats in numbers[5:].reshape(-1, 5).tolist():
            spread[c] = tuple(a + b for a, b in zip(spread.get(c, (0, 0, 0, 0)), stats, strict=True))
    lefts = told.where("shard >= 0").groupBy("shard").applyInArrow(
        _keep_continuations(words), "shard int, n1 long, n2 long, n3 long, n4 long, more long"
    )
    rows = lefts.collect()
    release(told)
    n = [sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4)]
    more, pairs = sum(r.more for r in rows), int(found[4])
    own = discounts(*n)
    mass = float(np.dot(own[1:], [n[0], n[1], more])) / pairs if pairs else 1.0
    return Model(words, spread, discounts(*found[:4].tolist()), own, pairs, mass, hot, gram_discounts)


def _hot_words(words: Words, shards: list[int]) -> np.ndarray:
    """Ids of the words with more than ``HOT`` of a shard's mean tokens: 1 / HOT of them per shard at most."""
    limit = HOT * words.total / (1 << words.bits)
    found = [np.flatnonzero(words.shard(s)[1] > limit) + words.bases[s] for s in sorted(shards)]
    return np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Rows that the model isn't trained on: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    Perplexity is 10 ** (-score / n_tokens).  A null text is empty: one END.  Repeated rows score alike.
    """
    own = docs.select(*[col(c) for c in keep], col(text).cast("string").alias("text"))
    longs = [T.StructField(name, T.LongType()) for name in ("n_tokens", "n_known", "train_tokens")]
    doubles = [T.StructField(name, T.DoubleType()) for name in ("base_score", "score")]
    kind = T.StructType([*own.drop("text").schema.fields, *longs, *doubles])
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), kind)


def corpus_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = 2) -> DataFrame:
    """Every document scored by a model of those that are not held out (all null ids are trained on).

    An empty training set knows no word: every token then has the probability of an unknown one.
    """
    own = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    model = train(own.where(~held_out(F.col("doc_id"))).select("text"), order)
    scored = score_texts(own, model)
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
