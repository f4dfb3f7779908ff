"""Language identification by words first, then progressively shorter character n-grams.

A word that the model knows scores by its relative frequency in each language.  A word it does not know
is scored by its character n-grams: those of the longest length of which at least one is known, and if
none is, those one character shorter, down to single letters.  A text has the mean of its words' scores.

Words are runs of letters, lower-cased; a run is cut after every ``LONGEST`` letters, so that a text in a
script without blanks has many short words and not one long one.  All texts that may be learned from are
counted in Spark; what is broadcast is the model, whose size has a bound (``WORDS``, ``GRAMS``, ``CELLS``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.llm.base import col, strings
from clanmark.llm.words import byte_slices
from clanmark.sources.workspace import materialize, release

UNKNOWN = "und"
#: Letters of a word at most, and characters of the longest n-gram (one blank stands at either end of a word).
LONGEST, ORDER = 32, 5
#: Words, and n-grams of each length, that a model has at most.
WORDS, GRAMS = 1 << 16, 1 << 15
#: Scores that a model has at most of words and of n-grams of each length: fewer of them with very many languages.
CELLS, LANGUAGES = 1 << 21, 512
#: Classes of shares in a factor of two; whole classes are in the model or not.
CLASSES = 32
#: Subtracted from the log10 of the least share in the model, for a language that lacks a word or n-gram.
PENALTY = 1.0
#: Bytes of texts taken apart at a time, and distinct words counted before they are handed on.
SLICE_BYTES, COUNTED = 1 << 20, 1 << 17

_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")


def words_of(text: str) -> list[str]:
    """The words of a text in order: runs of at most ``LONGEST`` letters and their marks, lower-cased."""
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between two blanks, in order; single ones are the letters."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log shares per language: ``scores[0]`` of words, ``scores[n]`` of n-grams of n characters."""

    languages: list[str]
    places: list[dict[str, int]]
    scores: list[np.ndarray]

    def backed_off(self, words: list[str]) -> np.ndarray:
        """A row per word: mean log shares of its longest known n-grams; zeros if not even a letter is known."""
        out = np.zeros((len(words), len(self.languages)))
        left = list(range(len(words)))
        for n in range(len(self.places) - 1, 0, -1):
            grams, get = [grams_of(words[i], n) for i in left], self.places[n].get
            at = np.array([get(gram, -1) for own in grams for gram in own], dtype=np.int64)
            row = np.repeat(np.arange(len(left)), [len(own) for own in grams])[at >= 0]
            known, where = np.bincount(row, minlength=len(left)), np.array(left, dtype=np.int64)
            for k in range(len(self.languages)):
                out[where, k] = np.bincount(row, self.scores[n][at[at >= 0], k], len(left)) / np.maximum(known, 1)
            left = where[known == 0].tolist()
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the scores of all words, a row per text and a column per language; words per text."""
        words = [words_of(text) for text in texts]
        counts = np.array([len(own) for own in words], dtype=np.int64)
        row, get = np.repeat(np.arange(len(texts)), counts), self.places[0].get
        at = np.array([get(word, -1) for own in words for word in own], dtype=np.int64)
        known, out = at >= 0, np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(row[known], self.scores[0][at[known], k], len(texts))
        if not known.all():
            flat = [word for own in words for word in own]
            unseen = [flat[i] for i in np.flatnonzero(~known).tolist()]
            number = {word: i for i, word in enumerate(dict.fromkeys(unseen))}
            np.add.at(out, row[~known], self.backed_off(list(number))[[number[word] for word in unseen]])
        return out, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; see ``identify``."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, counts = self.sums(texts)
        best = sums.argmax(1)
        sure = 1.0 / (10.0 ** (sums - sums.max(1, keepdims=True))).sum(1)
        return [self.languages[k] if n else UNKNOWN for k, n in zip(best, counts, strict=True)], np.where(counts > 0, sure, 0.0)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): counts of the words of some texts at a time."""

    def out() -> pa.RecordBatch:
        langs = [lang for lang, own in counts.items() for _ in own]
        words, n = ([x for own in counts.values() for x in part(own)] for part in (Counter.keys, Counter.values))
        columns = [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column("lang")
        for first, part in byte_slices(strings(batch.column("text")), SLICE_BYTES):
            for lang, text in zip(langs.slice(first, len(part)).to_pylist(), part.to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield out()
                counts = {}
    yield out()


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) over all rows with a text and a language; added up in tasks before the shuffle."""
    own = docs.select(col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text"))
    parts = own.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_counted, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """(kind, lang, word, n): n-grams of 1 to ``order`` characters (the kind) of all words, each as often as the words that hold it."""

    def cut(n: int) -> Column:
        padded = F.col("_padded" if n > 1 else "word")
        starts = F.sequence(F.lit(1), F.length("word") + (3 - n if n > 1 else 0))
        grams = F.transform(starts, lambda at: F.struct(F.lit(n).alias("kind"), F.substr(padded, at, F.lit(n)).alias("word")))
        return grams if n <= 3 else F.when(F.length("word") + 3 > n, grams).otherwise(F.slice(grams, 1, 0))

    words = words.withColumn("_padded", F.concat(F.lit(" "), "word", F.lit(" ")))
    grams = words.select("lang", F.explode(F.concat(*[cut(n) for n in range(1, order + 1)])).alias("g"), "n")
    return grams.groupBy("g.kind", "lang", "g.word").agg(F.sum("n").alias("n"))


def _known(counts: DataFrame, languages: list[str], most: list[int]) -> DataFrame:
    """(kind, word, lang, share) of the entries in the model: of kind k at most ``most[k]`` words.

    A word's class is that of its largest share in a language; the classes from the top on that fit
    whole are taken, so the choice needs a histogram and no sort of all words.
    """
    totals = counts.groupBy("kind", "lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["kind", "lang"]).select("kind", "word", "lang", (F.col("n") / F.col("total")).alias("share"))
    words = shares.groupBy("kind", "word").agg(F.floor(F.log2(F.max("share")) * CLASSES).alias("class"))
    words = materialize(words, "classes")
    held: dict[int, list] = {}
    for r in words.groupBy("kind", "class").count().orderBy("kind", F.desc("class")).collect():
        held.setdefault(r["kind"], []).append((r["class"], r["count"]))
    chosen = F.lit(False)
    for kind, classes in held.items():
        fits = np.cumsum([n for _, n in classes]) <= min(most[kind], CELLS // max(1, len(languages)))
        if fits.any():
            chosen = chosen | ((F.col("kind") == kind) & (F.col("class") >= classes[int(fits.sum()) - 1][0]))
    picked = words.where(chosen).select("kind", "word")
    return shares.join(F.broadcast(picked), ["kind", "word"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS, order: int = ORDER) -> Model:
    """A model of all rows of ``docs`` with a text and a language.

    The ``LANGUAGES`` languages with most words (ties: by name) are learned.  N-grams are counted from the
    table of distinct words, not from the texts again.  Without any word the model has no language.
    """
    counts = materialize(word_counts(docs, text, lang), "words")
    by_size = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in by_size)
    learned = counts.where(F.col("lang").isin(languages)) if len(languages) == LANGUAGES else counts
    both = learned.select(F.lit(0).alias("kind"), "lang", "word", "n").unionByName(gram_counts(learned, order))
    both = materialize(both, "grams")
    known = materialize(_known(both, languages, [words, *[grams] * order]), "known")
    places, scores = [], []
    for kind in range(order + 1):
        own = known.where(F.col("kind") == kind).select("word", "lang", "share").toArrow()
        column = own.column("word").combine_chunks().dictionary_encode()
        place, lang = np.asarray(column.indices), pc.index_in(own.column("lang"), pa.array(languages, pa.string())).to_numpy()
        share = np.zeros((len(column.dictionary), len(languages)))
        share[place, lang] = own.column("share").to_numpy()
        places.append({word: k for k, word in enumerate(column.dictionary.to_pylist())})
        least = share[share > 0].min(initial=1.0)
        logs = np.where(share > 0, np.log10(np.where(share > 0, share, 1.0)), np.log10(least) - PENALTY)
        scores.append(logs.astype(np.float32))
    release(counts, both, known)
    return Model(languages, places, scores)


def _identified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in byte_slices(strings(batch.column("text")), SLICE_BYTES):
                names, sure = shared.value.predict(part.to_pylist())
                row = batch.column("row").slice(first, len(part))
                yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """(row, lang_pred, score): the columns ``keep`` as one struct, and the language of every whole text.

    The language of the highest sum of log shares, ties by name; ``und`` with score 0 for a null text, one
    without a letter, or a model without a language.  A word without any known letter does not count.  The
    score is the share of the best language when each language weighs 10 to the power of its sum: 1 divided by the
    number of languages if they are even (a text of unknown letters), near 1 for a long text in one language.
    Repeated rows get equal results; a very long text is read whole, in one task.
    """
    row = F.struct(*[col(c) for c in keep]).alias("row")
    own = docs.select(row, col(text).cast("string").alias("text"))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return own.mapInArrow(_identified(shared), T.StructType([own.schema["row"], *more]))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of documents.

    Learned from the text and lang of rows that are not held out and whose id is not null; a row with a null
    id is neither held out nor learned from.
    """
    own = docs.select(*[col(c) for c in ("doc_id", "text", "lang")])
    learned = own.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    found = identify(own, train(learned), ["doc_id"]).select("row.*", "lang_pred", "score")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
