import zlib

import numpy as np
import pyarrow as pa
import pytest

from clanmark.llm import voting
from clanmark.llm.base import table

from . import samples

FOLDER = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    docs = table(spark, FOLDER, "documents")
    got = voting.quality_scores(docs, table(spark, FOLDER, "labels")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == held(r.doc_id) for r in got)
    tested = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in tested]) >= 0.95
    bad = [a for a, b in tested if b == 0]
    assert len(bad) >= 5 and np.mean(bad) <= 0.2


def test_held_out_labels_are_not_learned(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    turned = labels.withColumn("quality", voting.F.when(voting.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    a, b = (sorted(map(tuple, voting.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_votes_are_exact_cosine_products():
    texts = pa.array([samples.words(i % 5, 40 + i) for i in range(60)])
    counts = voting.features(texts)
    labels = np.arange(60) % 2
    model = voting.fit(counts, labels, rank=8)
    got = model.score(counts[:7])
    for x, score in zip(model.latent(counts[:7]), got):
        cosine = model.voters @ x
        near = np.argsort(-cosine)[: voting.NEIGHBOURS]
        weight = np.maximum(cosine[near].astype(float), 0) ** voting.POWER
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-6)


def test_features_count_words_and_shapes():
    counts = voting.features(pa.array(["", "a b a", "A1! $$$ |"]))
    assert counts[:, : voting.WORD_SLOTS].sum(1).tolist() == [0, 3, 3] == counts[:, voting.WORD_SLOTS :].sum(1).tolist()


def test_odd_rows(spark):
    docs = samples.documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 40)] + [(None, 1), (11, None), (999, 0), (12, 1)], "doc_id long, quality int")
    got = voting.quality_scores(docs, labels).collect()
    assert len(got) == len(samples.texts()) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    none = voting.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert voting.quality_scores(samples.empty(spark), labels).count() == 0
    assert voting.keep_good(docs, labels).columns == docs.columns
