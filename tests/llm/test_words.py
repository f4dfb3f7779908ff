import random
import re

import numpy as np
import pyarrow as pa

from clanmark.llm import words
from clanmark.llm.base import strings


def test_words_are_runs_without_blanks(monkeypatch):
    draw = random.Random(1)
    texts = ["".join(draw.choice("aAbB é日 \t\n\x0b\r\x1f ") for _ in range(draw.randint(0, 90))) for _ in range(300)] + [None, "", "x" * 500]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    for size in (7, 64, 1 << 17):
        monkeypatch.setattr(words, "SLICE", size)
        column = strings(pa.array(["cut off", *texts]).slice(1))
        hashes, first, end, at = words.word_spans(column)
        data, _ = words.buffers(column)
        assert [[data[a:b].tobytes() for a, b in zip(first[i:j], end[i:j])] for i, j in zip(at, at[1:])] == want
        seen: dict[bytes, int] = {}
        for word, h in zip((w for t in want for w in t), hashes.tolist()):
            assert seen.setdefault(word.lower(), h) == h
        assert len(set(seen.values())) == len(seen)


def test_slices_and_ragged_tables():
    column = pa.array(["a" * 10, "", "b" * 50, "c"])
    assert [(a, len(s)) for a, s in words.byte_slices(column, 20)] == [(0, 2), (2, 1), (3, 1)]
    flat = np.array([1, 2, 3, 4, 5])
    assert words.gathered(np.array([1, 0, 2, 1]), np.array([0, 2, 3]), np.array([2, 1, 0]), flat).tolist() == [3, 1, 2, 3]
