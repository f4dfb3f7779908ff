import random
from collections import defaultdict

from clanmark.llm import winnowing as W

from . import samples


def passages(seed):
    draw = random.Random(seed)
    lines = [samples.words(i, draw.choice([0, 1, 3, 8])) for i in range(12)]
    return [(i, "\n".join(draw.choice(lines) for _ in range(draw.randint(1, 14)))) for i in range(60)]


def result(spark, rows, min_words):
    out = W.drop_repeated_runs(samples.documents(spark, rows), keep=("rid",), min_words=min_words)
    return {r.row.rid: (r.text, r.deleted) for r in out.collect()}


def test_against_brute_force(spark):
    for seed, min_words in ((1, 6), (2, 20)):
        rows = passages(seed)
        want, got = maximal(rows, min_words), result(spark, rows, min_words)
        assert len(got) == len(rows) and want
        for k, (_, text) in enumerate(rows):
            assert got[k][1] == want.get(k, [])
            left = [line for n, line in enumerate(text.split("\n")) if n not in want.get(k, [])]
            assert got[k][0] == "\n".join(left)


def test_passage_of_fifty_words_in_other_surroundings(spark):
    passage = samples.words(77, 52)
    rows = [(i, samples.words(i, 30) + "\n" + passage + "\n" + samples.words(100 + i, 30)) for i in range(5)]
    got = result(spark, rows, 50)
    assert got[0][1] == [] and all(got[i][1] == [1] and passage not in got[i][0] for i in range(1, 5))


def test_odd_rows(spark):
    rows = samples.texts()
    got = result(spark, rows, 50)
    assert len(got) == len(rows) and all(got[k][0] == t for k, (_, t) in enumerate(rows) if not got[k][1])
    assert result(spark, [], 50) == {} and W.drop_repeated_runs(samples.empty(spark)).count() == 0
    blank = [(1, "\n" * 3000 + samples.words(1, 60)), (2, samples.words(1, 60) + "\n" * 500)]
    got = result(spark, blank, 50)
    assert got[0][1] == [] and got[1][1] == [0]


def maximal(rows, min_words):
    """Lines of every row in a maximal run of ``min_words`` words or more that occurs earlier, pair by pair."""
    ordered = sorted(((i is None, i or 0, k) for k, (i, _) in enumerate(rows)))
    texts = []
    for _, _, k in ordered:
        words = [tuple(x.lower() for x in line.split()) for line in (rows[k][1] or "").split("\n")]
        texts.append((k, [(n, w) for n, w in enumerate(words) if w]))
    gone = defaultdict(set)
    for y, (k, later) in enumerate(texts):
        for x in range(y + 1):
            early = texts[x][1]
            for q in range(len(later)):
                for p in range(q if x == y else len(early)):
                    if early[p][1] != later[q][1] or (p and q and early[p - 1][1] == later[q - 1][1]):
                        continue
                    n = 0
                    while p + n < len(early) and q + n < len(later) and early[p + n][1] == later[q + n][1]:
                        n += 1
                    if sum(len(w) for _, w in later[q : q + n]) >= min_words:
                        gone[k] |= set(range(later[q][0], later[q + n - 1][0] + 1))
    return {k: sorted(v) for k, v in gone.items()}


def test_matches_go_at_their_full_extent(spark):
    for seed, min_words in ((1, 6), (2, 20), (3, 9)):
        rows = passages(seed)
        want, got = maximal(rows, min_words), result(spark, rows, min_words)
        assert want and {k: d for k, (_, d) in got.items() if d} == want


def test_short_lines_at_both_ends_of_a_run(spark):
    run = [samples.words(s, n) for s, n in ((1, 20), (2, 60), (3, 20), (4, 20))]
    rows = [(1, "\n".join([samples.words(5, 9), *run])), (2, "\n".join([*run[:2], "", *run[2:], samples.words(6, 70)]))]
    assert result(spark, rows, 50)[1][1] == [0, 1, 2, 3, 4]
    apart = [(1, "\n".join([run[1], samples.words(7, 60)])), (2, "\n".join([run[1], "", samples.words(7, 60)]))]
    assert result(spark, apart, 50)[1][1] == [0, 1, 2]
