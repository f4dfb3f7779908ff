"""Every query of the package over the small tables, against its SQL or its plain counterparts."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import pytest

import check
from clanmark.llm import voting
from clanmark.llm.base import load, table

from . import samples, test_grace, test_probminhash

FOLDER = "/root/testdata/sf0.001"
BASE = load()


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", list(BASE.ORACLES))
def test_sql(spark, con, name):
    result = check.compare(spark, con, FOLDER, name, BASE)
    assert result.startswith("ok"), result


def test_names():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {name.split("_")[0] for name in BASE.QUERIES}


def documents(spark):
    return {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}


@pytest.mark.parametrize("name", [n for n in BASE.QUERIES if n.split("_")[0] in ("op1", "op7")])
def test_one_row_per_document(spark, name):
    ids = [r.doc_id for r in BASE.QUERIES[name](spark, FOLDER).select("doc_id").collect()]
    assert sorted(ids) == sorted(documents(spark))


def test_decoded_digests(spark):
    texts = documents(spark)
    for r in BASE.QUERIES["op9_piece_bpe"](spark, FOLDER).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_near_classes(spark):
    texts = documents(spark)
    ids = sorted(texts)
    want = test_probminhash.brute([(i, texts[i]) for i in ids])
    found = defaultdict(list)
    for r in BASE.QUERIES["op8_probminhash"](spark, FOLDER).collect():
        found[r.class_id].append(ids.index(r.doc_id))
    assert sorted(sorted(g) for g in found.values()) == want


def test_pipeline(spark):
    """The stages against plain versions: what each keeps, and that packing has every kept document whole."""
    docs = table(spark, FOLDER, "documents")
    scores = voting.quality_scores(docs, table(spark, FOLDER, "labels")).where("predicted = 1")
    texts = documents(spark)
    good = [(r.doc_id, texts[r.doc_id]) for r in scores.collect()]
    once = sorted({r[1] for r in test_grace.brute(good)})
    rows = [(i, texts[i]) for i in once]
    single = {min(once[k] for k in group) for group in test_probminhash.brute(rows)}
    placed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in placed} == single
    for i in single:
        pieces = sorted((r.piece, r.start, r.length) for r in placed if r.doc_id == i)
        assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(3), FOLDER).columns == docs.columns


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage."""
    docs = samples.documents(spark)
    plain = [re.sub(r"[ \t-\r]", "", t or "") for _, t in samples.texts()]
    good = corpus_pipeline.quality(spark, docs, FOLDER)
    assert good.columns == docs.columns and good.count() <= len(plain)
    once = corpus_pipeline.exact_dedup(spark, docs, FOLDER)
    left = [re.sub(r"[ \t-\r]", "", r.text or "") for r in once.collect()]
    assert once.columns == docs.columns and sorted(left) == sorted(set(plain))
    apart = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert apart.columns == docs.columns and apart.count() == len(test_probminhash.brute(samples.texts()))
    placed = corpus_pipeline.packing(spark, docs, FOLDER).collect()
    assert sum(r.piece == 0 for r in placed) == len(plain)
