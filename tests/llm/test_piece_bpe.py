import random

import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from clanmark.llm import piece_bpe

from . import samples

ODD = ["", "  ", " a  b\n\n c ", "a b", "a  b", "x　 　y", "\x1c a\x1cb", "é  à  b", "it's we'll 'S ''", "日本語 ok", "\U0001f600‍\U0001f469x", "x\x85 y", "a" * 4000]


@pytest.fixture(scope="module")
def library():
    ranks = piece_bpe.read_ranks(piece_bpe.BYTE_BPE)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(library):
    draw = random.Random(4)
    letters = "ab 'sS.,!1\n\t é́ =\x01\x1f日　\r"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 40))) for _ in range(2000)]
    codec = piece_bpe.codec(piece_bpe.BYTE_BPE)
    ids, at = codec.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]
    raw, at = codec.decode(ids, at)
    assert [raw[at[i] : at[i + 1]].tobytes().decode() for i in range(len(texts))] == texts


def test_rows(spark, library):
    rows = samples.texts() + list(enumerate(ODD))
    docs = samples.documents(spark, rows)
    coded = piece_bpe.decode_ids(piece_bpe.encode_texts(docs))
    got = sorted(((r.row.doc_id is None, r.row.doc_id or 0, r.row.text or "", r.ids, bytes(r.decoded)) for r in coded.collect()), key=str)
    want = sorted(((i is None, i or 0, t or "", library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert got == want
    assert piece_bpe.digests(docs).count() == len(rows) and piece_bpe.digests(samples.empty(spark)).count() == 0


def test_the_cache_keeps_no_long_chunks(library):
    texts = ["日本語学校" * 400 + str(i) for i in range(20)] + ["short words stay", "日本"]
    codec = piece_bpe.PieceCodec(piece_bpe.BYTE_BPE)
    for _ in range(2):
        ids, at = codec.encode(pa.array(texts))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]
    assert codec.known and max(map(len, codec.known)) <= piece_bpe.LONGEST_CACHED
