"""Near-duplicate documents by ProbMinHash over weighted shingles, banding and exact verification.

Every shingle of a document arrives as a Poisson process whose rate is its weight; each arrival falls
into a random register, and a register keeps the element of its first arrival.  Two documents agree
in a register with the probability Jaccard similarity of their weighted shingles.  A shingle stops
once its next arrival is later than the last first arrival of all registers.  Documents that agree in
a band of registers are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.llm.base import col, schema, strings, whole_row
from clanmark.llm.words import byte_slices, mixed, powers, word_hashes
from clanmark.operators.components import component_edges
from clanmark.operators.numbering import rank_within
from clanmark.sources.workspace import materialize, release

WORDS = 5
SIMILARITY = 0.8
#: What repetition adds to the weight of a shingle at most.
REPEATED = 0.25
#: At a similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8^5)^25 = 0.99995.
BANDS, ROWS = 25, 5
SLICE_BYTES, SLICE_DOCS = 2 << 20, 2048
#: Members of a bucket that are compared with as many others in one group.
BLOCK = 256
COLUMNS = 8192

SIGNED = "uid long, f1 long, f2 long, bands array<long>"
_ORDER_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_DOC_SHIFT = np.uint64(52)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for first, part in byte_slices(texts, SLICE_BYTES):
        for at in range(0, len(part), SLICE_DOCS):
            yield first + at, part.slice(at, SLICE_DOCS)


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the sequence of words of each text: equal for copies in words."""
    counts = np.diff(offsets)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
    found = []
    for base in _ORDER_BASES:
        step = powers(base | 1, int(counts.max(initial=0)) + 1)
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mixed(hashes ^ np.uint64(base)) * step[place], out=sums[1:])
        found.append(mixed(sums[offsets[1:]] - sums[offsets[:-1]] + counts.astype(np.uint64)))
    return found[0], found[1]


def shingle_sets(
    hashes: np.ndarray, offsets: np.ndarray, whole: np.ndarray, words: int = WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in order of text, the text of each, and how often it occurs.

    A text with fewer words than a shingle is one shingle (``whole``); a text without words has none.
    """
    counts = np.diff(offsets)
    n = len(hashes)
    mixed_words = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for i in range(words if n >= words else 0):
        mixed_words = mixed_words * np.uint64(0x9FB21C651E98DF25) + hashes[i : n - words + 1 + i]
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[: n - words + 1] == row[words - 1 :] if n >= words else np.zeros(0, dtype=bool)
    own, doc = mixed(mixed_words[inside]), row[: len(inside)][inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    own, doc = np.concatenate([own, whole[short]]), np.concatenate([doc, short])
    keys = np.sort((doc.astype(np.uint64) << _DOC_SHIFT) | (own >> np.uint64(12)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    distinct = keys[first]
    return distinct & np.uint64((1 << 52) - 1), (distinct >> _DOC_SHIFT).astype(np.int64), times


def shingle_weights(times: np.ndarray) -> np.ndarray:
    """Weight of a shingle by how often it occurs: from 1 for once towards ``1 + REPEATED``.

    Links are a matter of plain sets, so repetition must not move a pair far apart: two texts of
    which one repeats shared shingles any number of times keep a probability Jaccard of 0.73 at
    least where their sets have 0.8, and share a band with probability 0.997 at least.
    """
    return 1.0 + REPEATED * (1.0 - 1.0 / times)


def prob_min_hash(elements: np.ndarray, doc: np.ndarray, weights: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The signatures of ``docs`` documents: per register the element of the first arrival.

    Round j draws the j-th arrival of all elements that still can be first somewhere; their number
    falls from round to round.
    """
    first = np.full(docs * registers, np.inf)
    signature = np.zeros(docs * registers, dtype=np.uint64)
    time = np.zeros(len(elements))
    live = np.arange(len(elements))
    turn = 0
    while len(live):
        turn += 1
        drawn = mixed(elements[live] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        wait = -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time[live] += wait / weights[live]
        register = (mixed(drawn ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        cell = doc[live] * registers + register
        now = time[live]
        soon = now < first[cell]
        cell, now, elements_now = cell[soon], now[soon], elements[live[soon]]
        np.minimum.at(first, cell, now)
        best = first[cell] == now
        signature[cell[best]] = elements_now[best]
        last = first.reshape(docs, registers).max(1)
        live = live[time[live] < last[doc[live]]]
    return signature.reshape(docs, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of a signature."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _sign(bands: int, rows: int, words: int):
    """Rows with their fingerprint and band keys, without their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in _parts(strings(batch.column("text"))):
                hashes, offsets = word_hashes(texts)
                f1, f2 = fingerprints(hashes, offsets)
                elements, doc, times = shingle_sets(hashes, offsets, f1, words)
                weights = shingle_weights(times)
                keys = band_keys(prob_min_hash(elements, doc, weights, len(texts), bands * rows), bands, rows)
                none = np.bincount(doc, minlength=len(texts)) == 0
                ends = np.concatenate([[0], np.cumsum(np.where(none, 0, bands))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(keys[~none].reshape(-1))))
                kept = batch.slice(first, len(texts)).drop_columns(["text"])
                own = [pa.array(np.arange(uid, uid + len(texts))), pa.array(_signed(f1)), pa.array(_signed(f2)), lists]
                uid += len(texts)
                yield pa.RecordBatch.from_arrays([*own, *kept.columns], ["uid", "f1", "f2", "bands", *kept.schema.names])

    return run


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f1, f2, text): a text for each fingerprint of a batch."""
    for batch in batches:
        texts = strings(batch.column("text"))
        found = [fingerprints(*word_hashes(part)) for _, part in _parts(texts)]
        f1, f2 = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        _, at = np.unique(f1, return_index=True)
        at = pa.array(np.sort(at))
        yield pa.RecordBatch.from_arrays([pa.array(_signed(f1)).take(at), pa.array(_signed(f2)).take(at), texts.take(at)], ["f1", "f2", "text"])


def _sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    out: list[np.ndarray] = []
    for _, part in _parts(strings(texts)):
        hashes, offsets = word_hashes(part)
        f1, _ = fingerprints(hashes, offsets)
        elements, doc, _ = shingle_sets(hashes, offsets, f1, words)
        out += np.split(elements, np.searchsorted(doc, np.arange(1, len(part))))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def _verify(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            coded = [strings(batch.column(c)).dictionary_encode() for c in ("text_a", "text_b")]
            sets = [_sets_of(c.dictionary, words) for c in coded]
            a, b = (c.indices.to_pylist() for c in coded)
            values = [jaccard(sets[0][a[i]], sets[1][b[i]]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("low"), pa.array(values, pa.float64())], ["rid", "low", "similarity"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, by products of blocks of a 0/1 matrix."""
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column = np.unique(elements, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, len(names), COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        matrix = np.zeros((len(sets), min(COLUMNS, len(names) - first)), dtype=np.float32)
        matrix[owner[low:high], column[low:high] - first] = 1.0
        both += matrix @ matrix.T
    return both


def _compare(words: int, similarity: float):
    """The links between rows of different classes in one group, as a forest over the classes."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rid, label = group.column("rid").to_numpy(), group.column("label").to_numpy()
        sets = _sets_of(pa.concat_arrays(group.column("text").chunks), words)
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = _shared(sets).astype(np.float64)
        union = size[:, None] + size[None, :] - both
        hit = (both >= similarity * union - 1e-9) & (label[:, None] != label[None, :]) & (union > 0)
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(hit)), strict=True):
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(rid[i]), int(rid[j])))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, label) of every representative: the lowest rid of its class."""
    forest = component_edges(links).select(F.col("a").alias("rid"), F.col("b").alias("_low"))
    return reps.select("rid").join(forest, "rid", "left").select("rid", F.coalesce("_low", "rid").alias("label"))


def _remaining(members: DataFrame, similarity: float) -> DataFrame:
    """The rows of (band, rid, low, label, similarity) that may have a link not yet seen, in groups.

    Rows of the class of the bucket's first row are inner, others outer.  Only pairs with an outer row
    are open.  Jaccard distances obey the triangle inequality: with r = 1 - ``similarity``, an inner
    row at distance d of the first row can only link to outer rows up to d + r, so inner rows nearer
    than the nearest outer row less r are left out.  Outer rows stand in blocks, each of which meets
    every later outer block and every inner block in a group of its own.
    """
    reach = 1.0 - similarity + 1e-9
    first = members.where("rid = low").select("band", F.col("label").alias("_main"))
    told = members.join(first, "band").withColumn("outer", F.col("label") != F.col("_main"))
    far = F.lit(1.0) - F.coalesce("similarity", F.lit(1.0))
    told = told.withColumn("far", far)
    near = told.where("outer").groupBy("band").agg(F.min("far").alias("_nearest"), F.count("*").alias("_outers"))
    told = told.join(near, "band")
    # A lone outer row has met the first row already; it still may link to other inner rows.
    told = told.where(F.col("outer") | ((F.col("far") >= F.col("_nearest") - reach) & (F.col("rid") != F.col("low"))))
    ranked = rank_within(told.select("band", "outer", "rid", "label"), ["band", "outer"], [F.asc("rid")], "place")
    ranked = materialize(ranked.withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("int")), "ranked")
    blocks = ranked.groupBy("band").agg(
        F.max(F.when(F.col("outer"), F.col("block"))).alias("_o"), F.max(F.when(~F.col("outer"), F.col("block"))).alias("_i")
    )
    own = ranked.join(blocks, "band")

    def pair(i: Column, kind: int, j: Column) -> Column:
        return F.struct(i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"))

    block, zero = F.col("block"), F.lit(0)
    to_outer = F.transform(
        F.sequence(zero, F.col("_o")), lambda j: pair(F.least(block, j), 0, F.greatest(block, j))
    )
    to_inner = F.when(F.col("_i").isNotNull(), F.transform(F.sequence(zero, F.coalesce("_i", zero)), lambda j: pair(block, 1, j)))
    from_inner = F.transform(F.sequence(zero, F.col("_o")), lambda i: pair(i, 1, block))
    nothing = F.slice(to_outer, 1, 0)
    groups = F.when(F.col("outer"), F.concat(to_outer, F.coalesce(to_inner, nothing))).otherwise(from_inner)
    return own.select("band", "rid", "label", F.explode(groups).alias("g")).select("band", "rid", "label", "g.*")


def near_classes(
    docs: DataFrame,
    text: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    keep: tuple[str, ...] = ("doc_id",),
    doc_id: str = "doc_id",
) -> DataFrame:
    """Every row of ``docs`` with its class of near duplicates: ``row`` (columns ``keep``), doc_id,
    class_id (the smallest doc_id of the class), class_size (rows), n_texts (different sequences of
    words in the class) and kept (true for one row of a class: smallest doc_id, then first read).

    A class is a connected component of pairs whose sets of shingles (``words`` words, A-Z lower-cased)
    have a Jaccard similarity of ``similarity`` or more.  Texts of fewer words are one shingle; texts
    without words (null, empty) are copies of each other.  Weights of shingles are 1 + ln(times).

    Copies in words stand for each other.  In a bucket all rows are compared with its first row; what
    stays in several classes is compared in blocks, so every pair that shares a bucket is either in one
    class already, excluded by the triangle inequality, or compared exactly.
    """
    row = F.struct(*[col(c) for c in keep]).alias("row")
    own = docs.select(row, col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    kind = schema(SIGNED, row=own.schema["row"].dataType, doc_id=T.LongType())
    signed = materialize(own.mapInArrow(_sign(bands, rows, words), kind), "signed")
    copies = signed.groupBy("f1", "f2").agg(F.min("uid").alias("rid"), F.first("bands").alias("bands"))
    reps = materialize(copies, "reps")

    exploded = reps.select("rid", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("rid").alias("low"), F.count("*").alias("size")).where("size > 1")
    members = materialize(exploded.join(buckets, "band"), "members")
    pairs = members.where("rid <> low").select("rid", "low").distinct()

    seen = members.select("rid").distinct()
    needed = reps.join(seen, "rid", "left_semi").select("rid", "f1", "f2")
    plain = own.select("text").mapInArrow(_first_texts, "f1 long, f2 long, text string")
    texts = materialize(plain.join(needed, ["f1", "f2"]).groupBy("rid").agg(F.first("text").alias("text")), "texts")
    left = texts.withColumnRenamed("text", "text_a")
    right = texts.select(F.col("rid").alias("low"), F.col("text").alias("text_b"))
    tested = pairs.join(left, "rid").join(right, "low").select("rid", "low", "text_a", "text_b")
    tested = materialize(tested.mapInArrow(_verify(words), "rid long, low long, similarity double"), "tested")
    links = tested.where(F.col("similarity") >= similarity).select(F.col("rid").alias("a"), F.col("low").alias("b"))

    labels = materialize(_labels(seen, links), "labels")
    known = members.where("size > 2").join(labels, "rid").join(tested, ["rid", "low"], "left")
    open_bands = known.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    groups = _remaining(known.join(open_bands, "band", "left_semi"), similarity)
    more = groups.join(texts, "rid").groupBy("band", "i", "kind", "j").applyInArrow(_compare(words, similarity), "a long, b long")
    more = materialize(more, "more")
    if not more.isEmpty():
        release(labels)
        labels = materialize(_labels(seen, links.unionByName(more)), "labels")

    classed = signed.join(reps.select("f1", "f2", "rid"), ["f1", "f2"]).join(labels, "rid", "left")
    classed = classed.select("row", "doc_id", "uid", "rid", F.coalesce("label", "rid").alias("label"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    totals = classed.groupBy("label").agg(
        F.min(order).alias("first"), F.count("*").alias("class_size"), F.countDistinct("rid").alias("n_texts")
    )
    return classed.join(totals, "label").select(
        "row",
        "doc_id",
        F.coalesce(F.col("first.doc_id"), -1 - F.col("label")).alias("class_id"),
        "class_size",
        "n_texts",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of near duplicates; its columns as they were.

    Classes are found on narrow rows; the whole ones meet only the numbers of those that go.
    """
    numbered = materialize(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    own = numbered.select("uid", F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text"))
    classes = near_classes(own, keep=("uid",))
    gone = materialize(classes.where(~F.col("kept")).select("row.uid"), "gone")
    kept = numbered.join(gone, "uid", "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
