import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from clanmark.llm import kneser_ney as K

from . import samples


def tokens(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", raw) + ["END"]


class Brute:
    """The textbook model, with dictionaries."""

    def __init__(self, texts):
        runs = [tokens(t) for t in texts]
        self.counts = Counter(w for r in runs for w in r)
        self.pairs = Counter(p for r in runs for p in zip(["BEGIN", *r], r))
        self.lefts = Counter(w for _, w in self.pairs)
        self.d2, self.d1 = (K.discounts(*[sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (self.pairs, self.lefts))
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.after = defaultdict(dict)
        for (v, w), c in self.pairs.items():
            self.after[v][w] = c
        self.mass = sum(self.d1[min(c, 3)] for c in self.lefts.values()) / len(self.pairs)

    def base(self, w):
        return math.log10((self.counts[w] + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def low(self, w):
        c = self.lefts[w]
        return (c - self.d1[min(c, 3)]) / len(self.pairs) + self.mass / (self.v + 1)

    def p(self, w, v):
        own = self.after.get(v)
        if not own:
            return self.low(w)
        total, mass, c = sum(own.values()), sum(self.d2[min(x, 3)] for x in own.values()), own.get(w, 0)
        return (max(c - self.d2[min(c, 3)], 0) + mass * self.low(w)) / total

    def score(self, text):
        run = tokens(text)
        return sum(math.log10(self.p(w, v)) for v, w in zip(["BEGIN", *run], run))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def corpus():
    draw = random.Random(9)
    vocabulary = [samples.words(i, 1) for i in range(60)]
    rows = [(1000 + i, " ".join(draw.choice(vocabulary[: 5 + i]) for _ in range(draw.randint(0, 40)))) for i in range(55)]
    return rows + [(3000, "the " * 900), (3001, "The the\tTHE É")] + samples.texts()


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, parts):
    rows = corpus()
    got = K.corpus_scores(samples.documents(spark, rows).repartition(parts)).collect()
    brute = Brute([t for i, t in rows if not held(i)])
    want = sorted(
        (str(i), held(i), len(tokens(t)), sum(brute.counts[w] > 0 for w in tokens(t)), brute.n, sum(map(brute.base, tokens(t))), brute.score(t))
        for i, t in rows
    )
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have):
        assert a[:5] == b[:5] and b[5:] == pytest.approx(a[5:], rel=1e-9)


def test_probabilities_of_all_words_sum_to_one():
    brute = Brute([t for _, t in corpus()])
    for context in ("BEGIN", b"the", b"never"):
        assert sum(brute.p(w, context) for w in brute.counts) + brute.p(b"unknown", context) == pytest.approx(1.0)


def test_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = K.corpus_scores(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_tables(spark):
    assert K.corpus_scores(samples.empty(spark)).count() == 0
    only = next(i for i in range(100) if held(i))
    got = K.corpus_scores(samples.documents(spark, [(only, "a b")])).first()
    assert got.n_tokens == 3 and got.n_known == 0 and got.train_tokens == 0 and got.score == 0.0


def test_model_files_need_a_mounted_folder():
    assert K.mounted("file:///a/b") == "/a/b" == K.mounted("/a/b")
    with pytest.raises(ValueError):
        K.mounted("hdfs://host/a")


class BruteOrder:
    """The textbook model of any order, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.grams = order, {order: Counter()}
        for t in texts:
            run = [*["BEGIN"] * (order - 1), *tokens(t)]
            self.grams[order].update(tuple(run[i : i + order]) for i in range(len(run) - order + 1))
        for n in range(order, 1, -1):
            below = self.grams[n - 1] = Counter()
            for gram, c in self.grams[n].items():
                below[gram[1:]] += c if gram[1] == "BEGIN" else 1
        self.d = {n: K.discounts(*[sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for n, x in self.grams.items()}
        self.after = defaultdict(list)
        for x in self.grams.values():
            for gram, c in x.items():
                self.after[gram[:-1]].append(c)

    def p(self, gram):
        n, c, own = len(gram), self.grams[len(gram)][gram], self.after[gram[:-1]]
        lower = self.p(gram[1:]) if n > 1 else 1 / (len(self.grams[1]) + 1)
        if not own:
            return lower
        mass = sum(self.d[n][min(x, 3)] for x in own)
        return (max(c - self.d[n][min(c, 3)], 0) + mass * lower) / sum(own)

    def score(self, text):
        run = [*["BEGIN"] * (self.order - 1), *tokens(text)]
        return sum(math.log10(self.p(tuple(run[i : i + self.order]))) for i in range(len(run) - self.order + 1))


def test_higher_orders_against_brute_force(spark):
    rows = corpus()
    for order, parts in ((3, 7), (4, 1)):
        brute = BruteOrder([t for i, t in rows if not held(i)], order)
        got = K.corpus_scores(samples.documents(spark, rows).repartition(parts), order=order).collect()
        want = sorted((str(i), len(tokens(t)), brute.score(t)) for i, t in rows)
        have = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
        assert len(want) == len(have)
        for a, b in zip(want, have):
            assert a[:2] == b[:2] and b[2] == pytest.approx(a[2], rel=1e-9)
    assert K.ORDER >= 3 and K.corpus_scores(samples.empty(spark), order=K.ORDER).count() == 0


def test_packed_arrays_come_back_and_take_little_room():
    draw = K.np.random.default_rng(1)
    ids = K.np.sort(draw.integers(0, 3000, (20000, 1)), axis=0)
    ids = K.np.hstack([ids, ids]).astype("<u4")
    for a in (ids, ids[:0], K.np.arange(5, dtype="<i8"), K.np.ones(7, "<u4")):
        assert K._unpacked(K._packed(a)) == a.tobytes()
    assert len(K._packed(ids)) < ids.nbytes / 4


def test_contexts_of_more_than_a_byte_holds(spark):
    rows = [(i, " ".join(f"a b w{(i * 7 + j) % 600}" for j in range(90)) + " a b c" * 40) for i in range(60)]
    brute = BruteOrder([t for i, t in rows if not held(i)], 3)
    got = K.corpus_scores(samples.documents(spark, rows).repartition(3), order=3).collect()
    assert max(c for g, c in brute.grams[3].items()) > 255 and len(brute.after[(b"a", b"b")]) > 255
    want = {i: brute.score(t) for i, t in rows}
    assert {r.doc_id: r.score for r in got} == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_counts_go_once_they_are_counted(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files.getAllFiles().mkString(" ")))

    def tables():
        return {p.name for p in Path(K.mounted(K.fresh_path(spark, "x"))).parent.glob("*") if re.match(r"(grams\d|lefts)-", p.name)}

    texts = spark.range(200).selectExpr("concat('a b w', id % 7, ' x', id) AS text")
    before, setting, stored = shuffles(), spark.conf.get(K.CLEANUP), tables()
    K.train(texts, 4)
    for _ in range(100):  # Spark deletes them at its leisure
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and tables() == stored and spark.conf.get(K.CLEANUP) == setting


def test_runs_against_a_dictionary(tmp_path, monkeypatch):
    draw = K.np.random.default_rng(3)
    heads = K.np.unique(draw.integers(0, 1 << 63, 3000, dtype="u8") * K.np.uint64(2))
    heads[:40] = K.np.arange(40)  # many in one place of the index
    size = K.np.where(draw.random(len(heads)) < 0.1, draw.integers(1, 400, len(heads)), 1)
    size[7] = 70_000  # more than two bytes tell
    first = K.np.concatenate([[0], K.np.cumsum(size)[:-1]])
    own = K.np.concatenate([K.np.sort(draw.choice(n * 2, n, replace=False)) for n in size])
    counts = draw.choice([1, 2, 3, 9, 254, 255, 256, 10**10], len(own), p=[0.5, 0.2, 0.1, 0.1, 0.025, 0.025, 0.025, 0.025])
    stats = K._run_stats(counts, first, first + size)
    for cut, known in ((0, heads), (K.CUT, heads), (0, K.np.arange(len(heads)).astype("<u4"))):
        monkeypatch.setattr(K, "CUT", cut)
        path = str(tmp_path / f"runs-{cut}-{known.dtype.itemsize}")
        K.write_runs(path, known, first, own, counts)
        held = K.Runs(path)
        assert bool(len(held.index)) == (cut == 0 and known.dtype.itemsize == 8)
        table = {(h, w): c for h, w, c in zip(K.np.repeat(known, size).tolist(), own.tolist(), counts.tolist())}
        place = {h: i for i, h in enumerate(known.tolist())}
        at = draw.integers(0, len(own), 5000)
        asked = [K.np.repeat(known, size)[at].astype(K.np.uint64), own[at] + draw.integers(-1, 2, len(at))]
        asked[0][::9] += K.np.uint64(1)
        plain = draw.random(len(at)) < 0.7
        got, found = held.look(*asked, plain)
        for h, w, p, c, row in zip(asked[0].tolist(), asked[1].tolist(), plain.tolist(), got.tolist(), found.tolist()):
            assert c == table.get((h, w), 0)
            assert row == (stats[place[h]].tolist() if p and h in place else [0, 0, 0, 0])


def test_model_files_hold_each_context_once(spark):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(400)}" for _ in range(300)) for _ in range(100)]
    model = K.train(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), 3)
    brute = BruteOrder(texts, 3)
    for order, name, context in ((3, "grams3", 8), (2, "pairs", 4)):
        sizes = [p.stat().st_size for p in Path(model.words.folder).glob(f"{name}-*")]
        contexts = {gram[:-1] for gram in brute.grams[order]}
        wide = sum(len(brute.after[c]) > K.WIDE for c in contexts)
        assert sum(sizes) < 5 * len(brute.grams[order]) + (context + 3) * len(contexts) + 40 * wide + 1000 * len(sizes)


def test_parts_of_a_shard_make_the_same_files(tmp_path, monkeypatch):
    draw = K.np.random.default_rng(4)
    hot = K.np.array([3, 11])
    results = []
    for part in (K.PART, 50):
        draw = K.np.random.default_rng(4)
        words = K.Words(str(tmp_path / str(part)), 2, K.np.array([0, 10, 20, 25, 40]), 9000, 40)
        grams = [draw.integers(0, 40, 9000), draw.integers(0, 41, 9000), draw.integers(0, 41, 9000)]
        mine = K._gram_home(words, hot, grams) == 1
        batch = K._gram_blobs(words, hot, [g[mine] for g in grams], draw.integers(1, 300, mine.sum()))
        group = K.pa.Table.from_batches([batch, batch.slice(0, 1), batch])
        monkeypatch.setattr(K, "PART", part)
        kept = K._keep_grams(words, hot, 3)((K.pa.scalar(1),), group).to_pylist()
        told = sorted((r["shard"], K._unpacked(r["keys"]), K._unpacked(r["counts"])) for r in kept)
        results.append((told, (tmp_path / str(part) / "grams3-1").read_bytes()))
    assert mine.sum() > 500 and results[0] == results[1]
    runs = K.Runs(str(tmp_path / "50" / "grams3-1"))
    want = Counter()
    draw = K.np.random.default_rng(4)
    grams = [draw.integers(0, 40, 9000), draw.integers(0, 41, 9000), draw.integers(0, 41, 9000)]
    for gram, c in zip(K.np.stack(grams, 1)[mine].tolist(), draw.integers(1, 300, mine.sum()).tolist()):
        want[tuple(gram)] += 3 * c
    asked = K._columns(K.np.array(list(want)))
    heads = K._gram_keys(words, hot, asked)[1]
    assert runs.look(heads, asked[0], heads == heads)[0].tolist() == list(want.values())
    assert len(runs.own) == len(want) and len(runs.heads) == len({g[1:] for g in want})
