"""Token ids of whole text columns: each distinct chunk of a batch goes through the tokenizer once.

The tokenizer lower-cases, drops white space and splits into runs of letters, single digits and runs
of other characters.  A text is cut where such a boundary is certain from two neighbouring ASCII
bytes; between two cuts lies a chunk, and the ids of a text are those of its chunks in order.  The exact
string of a special token is a chunk of its own where the encoder is asked for special tokens.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import public_tokenizers

from clanmark.llm.words import IS_BLANK, buffers, gathered

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Chunks that a Python worker keeps between batches, and characters of the longest of them; beyond them, what the texts at hand use is kept.
CACHED_CHUNKS, LONGEST_CACHED = 150_000, 64
#: Stands between chunks that are encoded in one call; a chunk that holds it is encoded alone.
MARK = "\x01"

_BLANK, _LETTER, _DIGIT, _OTHER, _WIDE = range(5)
CLASS = np.full(256, _OTHER, dtype=np.uint8)
CLASS[IS_BLANK] = _BLANK
for _low, _high, _kind in (("a", "z", _LETTER), ("A", "Z", _LETTER), ("0", "9", _DIGIT)):
    CLASS[ord(_low) : ord(_high) + 1] = _kind
CLASS[128:] = _WIDE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(column: pa.Array, special: re.Pattern | None = None) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts without blanks, and where each text's chunks begin.

    A match of ``special`` inside a text is one chunk, found before letters are lower-cased.
    """
    data, offsets = buffers(column)
    n = len(data)
    kind = CLASS[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    solid = kind != _BLANK
    start = solid & begins[:n]
    if n > 1:
        left, right = kind[:-1], kind[1:]
        cut = (left != right) & (left != _WIDE) & (right != _WIDE) & (data[:-1] != ord("'"))
        cut |= (left == _DIGIT) & (right == _DIGIT)
        cut |= left == _BLANK
        start[1:] |= cut & solid[1:]
        plain = np.append(data[1:] < 128, True)  # a mark that follows may need the capital letter
        raw, data = data, np.where(plain, LOWER[data], data)
        for match in special.finditer(raw) if special else ():
            low, high = match.span()
            if not begins[low + 1 : high].any():  # else it begins in one text and ends in another
                start[low], start[low + 1 : high] = True, False
                if high < n:
                    start[high] = solid[high]
    at = np.flatnonzero(start[solid]).astype(np.int32)
    packed = np.ascontiguousarray(data[solid])
    ends = np.append(at, len(packed)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(packed))
    return found, np.searchsorted(np.flatnonzero(start), offsets)


class ChunkEncoder:
    """A tokenizer with its ids of known chunks.

    With ``special``, exact strings of special tokens are these tokens, as by the library's default;
    without, they are ordinary text, as with its ``encode_special_tokens``.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # those of ``special`` never reach it
        added = self.tokenizer.get_added_tokens_decoder().items() if special else ()
        self.special = {x.content: np.array([i], dtype=np.int32).tobytes() for i, x in added if x.special}
        longest = sorted(self.special, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(re.escape(x.encode()) for x in longest)) if longest else None
        self.mark = self._ids([MARK])[0]
        assert len(self.mark) == 1
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.int32) for x in found]

    def _learn(self, missing: list[str]) -> None:
        self.known.update(self.special)
        missing = [x for x in missing if x not in self.special]
        alone = [x for x in missing if MARK in x]
        for x, ids in zip(alone, self._ids(alone), strict=True):
            self.known[x] = ids.tobytes()
        rest = [x for x in missing if MARK not in x]
        for first in range(0, len(rest), 2000):  # an encoding takes far more room than its ids
            group = rest[first : first + 2000]
            ids = self._ids([f" {MARK} ".join(group)])[0]
            stops = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            raw, begin = ids.tobytes(), 0
            for x, stop in zip(group, stops.tolist(), strict=True):
                self.known[x] = raw[4 * begin : 4 * stop]
                begin = stop + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin."""
        found, offsets = chunks(column, self.pattern)
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


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, special: bool = False) -> ChunkEncoder:
    if (path, special) not in _encoders:
        _encoders[path, special] = ChunkEncoder(path, special)
    return _encoders[path, special]
