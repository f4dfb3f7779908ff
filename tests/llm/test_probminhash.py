import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clanmark.llm import probminhash as P
from clanmark.llm.words import word_hashes

from . import samples


def shingles(text):
    words = (text or "").lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= similarity * len(a | b)):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sorted(groups.values())


def chain(seed, n, step):
    """Texts each of which differs from the one before in a few words, and more and more from the first."""
    draw, words = random.Random(seed), samples.words(seed, 120).split()
    out = []
    for k in range(n):
        for _ in range(step):
            words[draw.randrange(len(words))] = f"w{seed}x{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def fixture():
    rows = samples.texts()
    for seed in range(6):
        rows += [(1000 * (seed + 1) + k, t) for k, t in enumerate(chain(seed + 50, 14, 1 + seed % 3))]
    shared = samples.words(999, 200)
    rows += [(9000 + k, shared + " " + samples.words(4000 + k, 90)) for k in range(25)]  # alike at about 0.5
    return rows


def groups(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.class_id].append(r)
    return found


def test_classes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rows = fixture()
    found = groups(P.near_classes(samples.documents(spark, rows), keep=("rid",)))
    assert sorted(sorted(r.row.rid for r in g) for g in found.values()) == brute(rows)
    for class_id, group in found.items():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert class_id == min(ids) if ids else class_id < 0
        assert all(r.class_size == len(group) for r in group) and sum(r.kept for r in group) == 1
        assert next(r for r in group if r.kept).doc_id == (min(ids) if ids else None)


def test_signatures_estimate_probability_jaccard():
    a, b = {1: 3.0, 2: 1.0, 3: 2.0, 4: 1.0}, {1: 1.0, 2: 1.0, 3: 2.0, 5: 5.0}
    want = sum(
        1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in {*a} & {*b}
    )
    hits, n = 0, 400
    for seed in range(n):
        names = P.mixed(np.arange(1, 6).astype(np.uint64) + np.uint64(seed * 1000)) >> np.uint64(12)
        rows = [(names[x - 1], d, w) for d, s in enumerate((a, b)) for x, w in s.items()]
        sketch = P.prob_min_hash(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), 2, 64)
        hits += int((sketch[0] == sketch[1]).sum())
    assert hits / (64 * n) == pytest.approx(want, abs=0.015)


@pytest.mark.parametrize("times", [1, 10, 100, 1000])
def test_repeated_blocks_lose_no_links(times):
    """Sets of similarity 0.8, half of what they share ``times`` over in one text: nearly all share a band."""
    shared, pairs = 80, 0
    for seed in range(300):
        names = P.mixed(np.arange(120).astype(np.uint64) + np.uint64(seed << 20)) >> np.uint64(12)
        first, second = np.arange(90), np.concatenate([np.arange(shared), np.arange(100, 110)])
        elements = np.concatenate([names[first], names[second]])
        n = np.where(np.arange(180) < shared // 2, times, 1).astype(float)
        doc = np.repeat([0, 1], 90)
        keys = P.band_keys(P.prob_min_hash(elements, doc, P.shingle_weights(n), 2, P.BANDS * P.ROWS), P.BANDS, P.ROWS)
        pairs += bool((keys[0] == keys[1]).any())
    assert pairs >= 0.99 * 300


def test_shingles_and_similarity():
    texts = ["a b c d e f a b c d e", "a b", "", "A b C d e", samples.words(3, 400)]
    hashes, at = word_hashes(pa.array(texts))
    f1, _ = P.fingerprints(hashes, at)
    _, doc, times = P.shingle_sets(hashes, at, f1)
    assert np.bincount(doc, weights=times, minlength=5).tolist() == [7, 1, 0, 1, 396]
    assert np.bincount(doc, minlength=5).tolist() == [len(shingles(t)) for t in texts]
    sets = P._sets_of(pa.array(texts), 5)
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            x, y = shingles(s), shingles(t)
            assert P.jaccard(sets[i], sets[j]) == pytest.approx(len(x & y) / len(x | y) if x or y else 1.0)
    assert P._shared([s for s in sets if len(s)])[0, 2] == 1


def test_hot_group_and_empty(spark):
    base = samples.words(5, 300).split()
    rows = [(i, " ".join([*base[:150], f"x{i}", *base[151:]])) for i in range(300)] + [(1000 + i, samples.words(i, 50)) for i in range(50)]
    found = groups(P.near_classes(samples.documents(spark, rows)))
    assert sorted(len(g) for g in found.values()) == [1] * 50 + [300]
    assert P.near_classes(samples.empty(spark)).count() == 0
    docs = samples.documents(spark, rows[:20])
    out = P.drop_near_copies(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [0]
