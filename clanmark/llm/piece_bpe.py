"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Each byte is mapped to a character of its own, each entry of the vocabulary to a piece scored by
its negative rank, and normalisation is the identity; merging the best-scored pair is then merging
the lowest rank.  Pre-tokens of the public pattern are encoded one by one, and ids are decoded by
the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.llm.base import col, schema, strings
from clanmark.llm.words import IS_BLANK, buffers, byte_slices, gathered

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Byte b is written as the character FIRST + b: none is white space or changed by sentencepiece.
FIRST = 0x100
#: Chunks that a Python worker keeps between batches, and characters of the longest of them.
CACHED_CHUNKS, LONGEST_CACHED = 300_000, 64
SLICE_BYTES = 4 << 20

_TO_CHARS = {b: FIRST + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown one, piece i + 1 the entry of i-th rank."""
    unknown = _block(1, _block(1, b"<unk>") + _number(3, 2))
    pieces = [
        _block(1, _block(1, as_chars(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    no_id = -1
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, 0) + b"".join(_number(k, no_id) for k in (41, 42, 43))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([unknown, *pieces, _block(2, trainer), _block(3, normalizer)])


def chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts cut before each ASCII blank that follows a character other than white space.

    The pattern never matches from such a character into white space, and a run of white space stays
    with what follows it, so the matches of a text are those of its chunks.
    """
    data, offsets = buffers(column)
    n = len(data)
    start = np.zeros(n + 1, dtype=bool)
    if n > 1:
        blank = IS_BLANK[data]
        start[1:n] = blank[1:] & ~blank[:-1]
        # Wide white space before a blank: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000.
        at = np.flatnonzero(start[:n] & np.append(False, data[:-1] >= 128))
        at = at[at > 2]
        a, b, c = data[at - 3], data[at - 2], data[at - 1]
        wide = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        wide |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        wide |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        start[at[wide]] = False
        start[1:3] = False
    start[offsets] = True
    start[n] = False
    at = np.flatnonzero(start).astype(np.int32)
    ends = np.append(at, n).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return found, np.searchsorted(at, offsets)


class PieceCodec:
    """Encoder and decoder of one rank file, with the ids of known chunks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        ranks = read_ranks(path)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.ranks = ranks
        self.rank_of_piece = np.array([-1, *[rank for _, rank in by_rank]], dtype=np.int32)
        self.model = SentencePieceProcessor(model_proto=model_of(ranks))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}
        tokens = {rank: token for token, rank in by_rank}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(x) for x in parts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def _learn(self, missing: list[str]) -> None:
        split = [[x.encode() for x in self.pattern.findall(chunk)] for chunk in missing]
        tokens = list({x for pre_tokens in split for x in pre_tokens})
        found: dict[bytes, bytes] = {}
        rest = []
        for token in tokens:
            rank = self.ranks.get(token)
            if rank is None:
                rest.append(token)
            else:
                found[token] = struct.pack("<i", rank)
        pieces = self.model.encode([as_chars(x) for x in rest], out_type=int, num_threads=1) if rest else []
        for token, ids in zip(rest, pieces, strict=True):
            found[token] = self.rank_of_piece[ids].tobytes()
        for chunk, pre_tokens in zip(missing, split, strict=True):
            self.known[chunk] = b"".join([found[x] for x in pre_tokens])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin."""
        found, offsets = chunks(column)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [x for x in distinct if x not in self.known]
        if len(self.known) + len(missing) > CACHED_CHUNKS:  # what these texts use is kept
            self.known = {x: self.known[x] for x in distinct if x in self.known}
        self._learn(missing)
        parts = [self.known[x] for x in distinct]
        for x in missing:  # a text without blanks is one chunk: the cache is for words
            if len(x) > LONGEST_CACHED:
                del self.known[x]
        lengths = np.array([len(x) for x in parts], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(parts), dtype=np.int32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids = gathered(codes, np.cumsum(lengths) - lengths, lengths, flat)
        return ids, np.concatenate([[0], np.cumsum(lengths[codes])])[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id lists, and where each list's bytes begin."""
        raw = gathered(ids, self.starts, self.lengths, self.bytes)
        return raw, np.concatenate([[0], np.cumsum(self.lengths[ids])])[offsets]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encoded(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in byte_slices(strings(batch.column("text")), SLICE_BYTES):
                ids, offsets = codec(path).encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, batch.column("row").slice(first, len(texts))], [name, "row"])

    return run


def encode_texts(
    docs: DataFrame, text: str = "text", path: str = BYTE_BPE, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """(ids, row): the ids of every whole text (null: none), and its columns ``keep`` (all) as a struct.

    No special tokens: their strings are ordinary text.  Rows keep their number and order within a
    task; repeated rows are encoded each; a text of any length is one list.
    """
    row = F.struct(*[col(c) for c in docs.columns if keep is None or c in keep])
    own = docs.select(row.alias("row"), col(text).cast("string").alias("text"))
    return own.mapInArrow(_encoded(path, "ids"), schema("ids array<int>", row=own.schema["row"].dataType))


def decode_ids(df: DataFrame, ids: str = "ids", name: str = "decoded", path: str = BYTE_BPE) -> DataFrame:
    """``df`` plus the BINARY that its list of ids stands for (null list: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            counts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            raw, offsets = codec(path).decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), counts)
            found = pa.BinaryArray.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again."""
    coded = encode_texts(docs, text, path, (doc_id,))
    both = decode_ids(coded.select(F.col("row").getField(doc_id).cast("long").alias("doc_id"), "ids"), path=path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
