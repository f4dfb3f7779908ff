import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clanmark.llm import packing, word_tokens

from . import samples
from .test_piece_bpe import ODD


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(word_tokens.WORD_BPE)
    made.encode_special_tokens = True
    return made


def test_ids_are_those_of_the_library(library):
    texts = ODD + ["H̱ Å ≠ ≮ 1́", "İstanbul ΣΑΣ ẞ", "<|endoftext|>x", "a\x01b \x01", "don't 'Tis x's'y"]
    ids, at = word_tokens.encoder(word_tokens.WORD_BPE).encode(pa.array(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [x.ids for x in want]


def test_best_fit():
    place, bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins == 2 and [place[i] for i in (0, 2)] == [place[0]] * 2 and len({place[1], place[3], place[4]}) == 1
    assert packing.best_fit(np.zeros(0, np.int64), 10)[1] == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_sequences(spark, library, capacity):
    rows = samples.texts()
    got = packing.pack_documents(samples.documents(spark, rows), capacity=capacity).collect()
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], "<u4")
            want.append((i, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    least = -(-sum(r.length for r in got) // capacity)
    assert len(sequences) <= 1.1 * least + 1


def test_rounds_without_gain_end_and_groups_are_bounded(spark):
    rows = spark.createDataFrame([(i, 60) for i in range(500)], "uid long, length long").repartition(6)
    bins = packing.pack_bins(rows, 100, task_items=50).collect()
    assert sorted(m for b in bins for m in b.members) == list(range(500)) and len(bins) == 500
    rows = spark.createDataFrame([(i, 1 + i % 50) for i in range(5000)], "uid long, length long").repartition(40)
    bins = packing.pack_bins(rows, 100).collect()
    assert sorted(m for b in bins for m in b.members) == list(range(5000))
    assert all(sum(b.sizes) == b.fill <= 100 for b in bins) and len(bins) <= 1.02 * sum(1 + i % 50 for i in range(5000)) / 100


def test_empty(spark):
    assert packing.pack_documents(samples.empty(spark)).count() == 0
    ids = packing.token_pieces(samples.documents(spark, [(1, "a b")]), with_ids=True).first()
    assert len(ids.ids) == 4 * ids.length


SPECIAL = ["see <|endoftext|> here", "<|startoftext|>a<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof", "text|> é<|endoftext|>́x", "A<|endoftext|>"]


def test_special_tokens_are_those_of_the_unmodified_library(spark):
    plain = Tokenizer.from_file(word_tokens.WORD_BPE)
    texts = SPECIAL + ODD + ["x"]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [862, 49407, 763]
    ids, at = word_tokens.encoder(word_tokens.WORD_BPE, special=True).encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    rows = packing.token_pieces(samples.documents(spark, list(enumerate(SPECIAL))), with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*want[i], 0] for i in range(len(SPECIAL))}


def test_the_cache_keeps_no_long_chunks():
    """Texts in a script without blanks are one chunk each."""
    texts = ["日本語学校" * 400 + str(i) for i in range(20)] + ["short words stay", "日本"]
    encoder = word_tokens.ChunkEncoder(word_tokens.WORD_BPE, False)
    first = encoder.encode(pa.array(texts))
    assert encoder.known and max(map(len, encoder.known)) <= word_tokens.LONGEST_CACHED
    assert all((a == b).all() for a, b in zip(first, encoder.encode(pa.array(texts))))
