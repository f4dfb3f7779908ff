import hashlib

import numpy as np
import pytest

from clanmark.llm import threshold_centroids as C

KIND = "vec_id long, embedding array<float>, label string, cluster string, distance string, `a.b` string"


def brute(rows, k, rounds, dim):
    """Rounds of all distances, in Python integers."""
    use = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, "<i8").tobytes(), v) for i, v in use if i is not None)
    centres = [v for _, _, v in seeds[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in use:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(own) for x in zip(*own)] if own else c for c, own in zip(centres, groups)]
    placed = [(i, *nearest(v)[::-1]) for i, v in use]
    sums = {n: sum(d for _, m, d in placed if m == n) for n in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, sums[n], sum(sums.values()), digest[n]) for i, n, d in placed), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "l", "c", "d", "x") for i, v in rows], KIND).repartition(3)


def found(spark, rows, **options):
    return sorted(map(tuple, C.clusters(table(spark, rows), **options).collect()), key=str)


def vectors(seed, n, dim):
    draw = np.random.default_rng(seed)
    return [(i, v) for i, v in enumerate((draw.normal(0, 1, (5, dim))[draw.integers(0, 5, n)] + draw.normal(0, 0.2, (n, dim))).round(2).tolist())]


@pytest.mark.parametrize("dim", [3, 64])
def test_against_brute_force(spark, dim):
    rows = vectors(dim, 150, dim)
    assert found(spark, rows, k=7, rounds=3, dim=dim) == brute(rows, 7, 3, dim)


def test_odd_rows(spark):
    rows = vectors(5, 40, 3) + [(50, None), (51, []), (52, [1.0, 2.0]), (53, [float("nan"), 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0]), (55, [None, 0.0, 0.0])]
    rows += [(7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 8.0])] + [(60 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    assert found(spark, rows, k=12, rounds=2, dim=3) == brute(rows, 12, 2, 3)
    few = [(1, [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0])]
    assert found(spark, few, k=5, rounds=2, dim=3) == brute(few, 5, 2, 3)
    assert found(spark, [], dim=3) == [] and found(spark, [(None, [1.0, 2.0, 3.0])], dim=3) == []


def test_huge_components_are_clipped(spark):
    rows = [(i, [s * 1e30, 0.0, float(i)]) for i, s in enumerate((1, 1, -1, -1))]
    got = found(spark, rows, k=2, rounds=1, dim=3)
    assert len(got) == 4 and all(0 <= r[2] < 1 << 62 and r[3] >= r[2] for r in got)


def test_the_walk_stops_early_and_keeps_ties():
    draw = np.random.default_rng(1)
    centres = draw.integers(-100, 100, (60, 8))
    centres[30] = centres[2]
    x = np.concatenate([draw.integers(-120, 120, (500, 8)), centres])
    lists = C.Lists(centres)
    number, distance = lists.nearest(x)
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    seen = []
    real = np.einsum
    C.np.einsum = lambda *a: seen.append(len(a[1])) or real(*a)
    try:
        lists.nearest(centres)
    finally:
        C.np.einsum = real
    assert sum(seen) < 0.5 * len(centres) ** 2
