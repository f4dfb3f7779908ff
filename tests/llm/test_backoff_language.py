import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from clanmark.llm import backoff_language as L
from clanmark.llm.base import table

from . import samples

FOLDER = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, score string, lang_pred string, row string, `a.b` string"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain(rows, texts, order=L.ORDER):
    """The method word by word with dictionaries; all words and n-grams are in the model."""
    cut = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]{0,31}", t.lower())
    counts = [{} for _ in range(order + 1)]
    for text, lang in rows:
        for word in cut(text):
            counts[0].setdefault(lang, Counter())[word] += 1
            for n in range(1, order + 1):
                padded = f" {word} " if n > 1 else word
                counts[n].setdefault(lang, Counter()).update(padded[i : i + n] for i in range(len(padded) - n + 1))
    langs = sorted(counts[0])
    shares = [{lang: {w: c / sum(own.values()) for w, c in own.items()} for lang, own in kind.items()} for kind in counts]
    least = [min((s for own in kind.values() for s in own.values()), default=1.0) for kind in shares]

    def value(n, item, lang):
        share = shares[n].get(lang, {}).get(item)
        return np.log10(share) if share else np.log10(least[n]) - L.PENALTY

    def score(word, lang):
        if any(word in own for own in shares[0].values()):
            return value(0, word, lang)
        for n in range(order, 0, -1):
            padded = f" {word} " if n > 1 else word
            grams = [padded[i : i + n] for i in range(len(padded) - n + 1)]
            known = [g for g in grams if any(g in own for own in shares[n].values())]
            if known:
                return np.mean([value(n, g, lang) for g in known])
        return 0.0

    out = []
    for text in texts:
        words = cut(text or "")
        sums = [sum(score(w, lang) for w in words) for lang in langs]
        if not words or not langs:
            out.append(("und", 0.0))
        else:
            out.append((langs[int(np.argmax(sums))], 1 / sum(10.0 ** (s - max(sums)) for s in sums)))
    return out


def test_held_out_accuracy(spark):
    docs = table(spark, FOLDER, "documents")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = L.languages(docs).collect()
    assert len(got) == len(want) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    assert len(tested) > 150 and np.mean(tested) >= 0.98


def test_held_out_languages_are_not_learned(spark):
    docs = table(spark, FOLDER, "documents")
    turned = docs.withColumn("lang", L.F.when(L.held_out(docs.doc_id), "xx").otherwise(docs.lang))
    a, b = (sorted(map(tuple, L.languages(x).collect())) for x in (docs, turned))
    assert a == b


def test_against_plain_words_and_grams(spark):
    rows = [(samples.words(i, 30) + " Äöü ", "de") for i in range(5)] + [(samples.words(50 + i, 30) + " éçà zz", "fr") for i in range(4)]
    texts = [samples.words(i, 12) + " zzz éÄ" for i in range(40, 60)] + ["q", "qqq xxx", "日本", "zq", "", None, "12 ½ _ ²", "äöü", "a" * 100]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = L.train(docs)
    names, sure = model.predict([t or "" for t in texts])
    want = plain(rows, texts)
    assert names == [w[0] for w in want] and sure == pytest.approx([w[1] for w in want], abs=1e-4)


def test_odd_rows(spark):
    rows = samples.texts() + [(900, "x" * 200_000), (901, "日本語" * 5000), (902, "́́"), (903, "१२")]
    docs = spark.createDataFrame([(i, t, "ab"[k % 2] if k % 3 else None, "s", "p", "r", "x") for k, (i, t) in enumerate(rows)], KIND).repartition(3)
    got = L.languages(docs).collect()
    assert len(got) == len(rows) and all(r.lang_pred in ("a", "b", "und") for r in got)
    letters = Counter((i, bool(t and regex.search(r"\p{L}", t))) for i, t in rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert all((r.score == 0) == (r.lang_pred == "und") for r in got)
    assert L.languages(docs.limit(0)).count() == 0
    none = L.languages(docs.withColumn("lang", L.F.lit(None).cast("string")))
    assert none.count() == len(rows) and {r.lang_pred for r in none.collect()} == {"und"}


def test_the_size_of_the_model_is_bounded(spark):
    docs = spark.createDataFrame([(i, samples.words(i, 300), "ab"[i % 2]) for i in range(1, 40)], "doc_id long, text string, lang string")
    model = L.train(docs, words=50, grams=20)
    assert all(0 <= len(p) <= (50 if n == 0 else 20) for n, p in enumerate(model.places)) and len(model.places[1]) == 8
    assert [s.shape for s in model.scores] == [(len(p), 2) for p in model.places]
