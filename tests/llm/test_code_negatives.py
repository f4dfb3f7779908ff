import random

import numpy as np
from pyspark.sql import functions as F

from clanmark.llm import code_negatives as N
from clanmark.llm.vectors import floored, largest

KIND = "vec_id long, label long, vector array<long>, rank string, score string, `a.b` string"


def brute(rows, every, positives=5, negatives=5):
    """Whole definition pair by pair, in Python integers."""
    use = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v]
    anchors = {}
    for i, lab, v in use:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, len(v), v)), (lab, len(v), v))
    out = []
    for a, (label, dim, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, lab) for i, lab, v in use if i != a and len(v) == dim)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, pid, k, i, -p, -s) for k, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    full = [(*r, "r", "s", "x") for r in rows]
    df = spark.createDataFrame(full, KIND).repartition(4)
    return sorted(map(tuple, N.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def rows_around_centres(seed, n, dim, size=40):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, size, (6, dim))
    x = np.rint(centres[draw.integers(0, 6, n)] + draw.normal(0, size / 3, (n, dim))).astype(int)
    return [(i, int(draw.integers(0, 4)), v) for i, v in enumerate(x.tolist())]


def test_against_brute_force(spark):
    for seed, dim in ((1, 64), (2, 7), (3, 100)):
        rows = rows_around_centres(seed, 300, dim)
        want = brute(rows, 20)
        assert want and found(spark, rows, 20) == want
    assert found(spark, rows, 20, part_bytes=1, levels=1) == want


def test_odd_rows(spark):
    rows = rows_around_centres(4, 120, 8, 3) + [(1, 0, [1] * 8), (2, None, [1] * 8), (None, 1, [1] * 8), (500, 1, None), (520, 1, [])]
    rows += [(600 + i, i % 2, rows[3][2]) for i in range(40)] + [(700 + i, i % 3, [i, 1]) for i in range(30)] + [(800 + i, 1, [0] * 8) for i in range(4)]
    want = brute(rows, 20)
    assert want and found(spark, rows, 20) == want
    assert found(spark, [], 20) == [] and found(spark, rows[:1], 20) == []


def test_repeated_anchor_is_its_least_row(spark):
    rows = rows_around_centres(5, 80, 16) + [(0, 3, [9] * 16), (0, 1, [7] * 16)]
    assert found(spark, rows, 40) == brute(rows, 40)


def test_products_beyond_doubles(spark):
    draw = random.Random(6)
    rows = [(i, i % 2, [draw.randint(-(1 << 27), 1 << 27) | 1 for _ in range(64)]) for i in range(80)]
    want = brute(rows, 4)
    assert want and max(abs(r[4]) for r in want) > 1 << 56 and found(spark, rows, 4) == want
    most = largest(3)
    huge = [(i, i % 2, [1 << 62, -(1 << 62), i]) for i in range(8)]
    assert found(spark, huge, 4) == brute([(i, lab, [most, -most, v[2]]) for i, lab, v in huge], 4)


def test_intervals_hold_and_exclude():
    x = np.array([r[2] for r in rows_around_centres(7, 400, 64)])
    part = N.Part(np.arange(20), np.zeros(20, np.int64), x[:20])
    codes, scales, rest = N.encoded(x, N.LEVELS)
    estimate, error = part.intervals(slice(0, 20), codes, scales, rest)
    true = x[:20] @ x.T
    assert (np.abs(estimate - true) <= error).all()
    assert (estimate + error >= 0.6 * np.partition(true, -20, axis=1)[:, -20:-19]).mean() < 0.5
    assert np.allclose((N.rotated(x) ** 2).sum(1), (x**2).sum(1))


def test_components(spark):
    rows = [([0.5, -0.25, 1e-9],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],), ([1e308, -1e308],)]
    got = [r.s for r in spark.createDataFrame(rows, "v array<double>").select(floored("v", 256).alias("s")).collect()]
    assert got[:6] == [[128, -64, 0], None, None, None, None, []] and got[6][0] > 1 << 62 and got[6][1] < -(1 << 62)
