"""Joins that reduce inside the kernel, against dense numpy products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clanmark.operators import linkage, products as P
from clanmark.operators.linkage import agglomerative_average

from . import samples as X

LAYOUTS = [{}, dict(broadcast_bytes=0), dict(broadcast_bytes=0, unit_rows_limit=25, pivots=6), dict(broadcast_bytes=0, unit_rows_limit=16)]


@pytest.mark.parametrize("options", LAYOUTS)
@pytest.mark.parametrize("strict", [False, True])
def test_groups(spark, options, strict):
    matrix, _ = X.planted(seed=21, rows=220, hot=120)
    rng = np.random.default_rng(2)
    users = matrix[rng.choice(len(matrix), 40, replace=False)]
    users[3] = 0.0
    df = X.frame(spark, matrix).withColumn("g", F.struct((F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("y")))
    known = X.frame(spark, users).select(F.format_string("u%03d", "id").alias("uid"), F.col("v").alias("c"))
    sims = np.round(X.cosines(matrix, users), 12)
    want = {}
    for i, j in zip(*np.nonzero(sims > 0.7 if strict else sims >= 0.7)):
        best, n = want.get(key := (int(i % 7), int(i % 3) or None, f"u{j:03d}"), (-1.0, 0))
        want[key] = (max(best, sims[i, j]), n + 1)
    got = P.similarity_groups(df, known, "g", "id", "v", "uid", "c", 0.7, strict, **options).collect()
    assert want and len(got) == len(want)
    for r in got:
        best, n = want[r.a.x, r.a.y, r.b]
        assert r.n == n and abs(r.similarity - best) < 1e-9


def test_a_hot_group_leaves_a_unit_as_one_row(spark):
    df = spark.range(3000).select("id", F.lit("one").alias("g"), F.array(F.lit(1.0), F.col("id") * 1e-6).alias("v")).repartition(6)
    known = spark.createDataFrame([("u", [1.0, 0.0])], "uid string, c array<double>")
    for options in LAYOUTS[:2]:
        found = P.similarity_groups(df, known, "g", "id", "v", "uid", "c", 0.7, **options)
        assert [(r.a, r.b, r.n) for r in found.collect()] == [("one", "u", 3000)]
    groups, ids, n = P.pa.array(["one"] * 500), P.pa.array(["u"]), np.arange(500)
    rows = P._group_rows(groups, ids, iter([(n[:300], n[:300] * 0, n[:300] / 500.0), (n[300:], n[300:] * 0, n[300:] / 500.0)]))
    assert rows.to_pylist() == [{"a": "one", "b": "u", "similarity": 499 / 500, "n": 500}]
    empty = P.similarity_groups(df.limit(0), known, "g", "id", "v", "uid", "c", 0.7)
    assert empty.count() == 0


@pytest.mark.parametrize("options", LAYOUTS)
@pytest.mark.parametrize("over", [0.7, 0.1, -5.0])
def test_best_products_with_a_term(spark, options, over):
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(90, 6)) * rng.uniform(0.1, 0.9, (90, 1)), rng.normal(size=(140, 6)) * 0.4
    right[50:60] = right[40]  # equal products: the lower id
    right[7], left[9] = 0.0, 0.0
    bonus = np.round(rng.uniform(0, 0.05, 140), 3)
    bonus[50:60] = bonus[40]
    a = X.frame(spark, left)
    b = spark.createDataFrame([(int(i), [float(x) for x in v], float(t)) for i, (v, t) in enumerate(zip(right, bonus))], "n long, w array<double>, t double")
    got = {r.a: (r.b, r.similarity) for r in P.best_products(a, b, "id", "v", "n", "w", over, F.col("t"), **options).collect()}
    sums = np.round(left @ right.T + bonus, 12)
    sums[:, 7], sums[9] = -np.inf, -np.inf
    want = {i: int(sums[i].argmax()) for i in range(90) if sums[i].max() > over}
    assert len(want) > 5 and {i: b for i, (b, _) in got.items()} == want
    assert all(abs(s - sums[i].max()) < 1e-9 for i, (_, s) in got.items())


@pytest.mark.parametrize("options", LAYOUTS)
def test_best_products_of_other_rows(spark, options):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 5)) * rng.uniform(0.2, 1.0, (150, 1))
    x[20:24] = x[19]
    df = X.frame(spark, x)
    got = {r.a: r.b for r in P.best_products(df.where("id < 60"), df, "id", "v", "id", "v", 0.0, other=True, **options).collect()}
    sums = np.round(x[:60] @ x.T, 12)
    sums[np.arange(60), np.arange(60)] = -np.inf
    assert got == {i: int(sums[i].argmax()) for i in range(60) if sums[i].max() > 0}


def test_linkage_searches_fewer_rows_round_by_round(spark, monkeypatch):
    matrix, _ = X.planted(seed=2, rows=60, noise=0.5, hot=12, hot_noise=0.1)
    asked, real = [], linkage.best_products
    monkeypatch.setattr(linkage, "best_products", lambda left, *a, **k: asked.append(left.count()) or real(left, *a, **k))
    rows = agglomerative_average(X.frame(spark, matrix), "id", "v", 0.4, 4).collect()
    assert [c for _, c in sorted((r.id, r.cluster) for r in rows)] == X.average_linkage(matrix, 0.4)
    assert len(asked) > 2 and asked[3] < asked[0] / 2 and sum(asked) < len(asked) * asked[0] / 3


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e25, 1e160])
def test_best_places_equal_those_in_double_precision(scale):
    rng = np.random.default_rng(8)
    right = rng.normal(size=(300, 6))
    right = np.concatenate([right, right[:120], np.repeat(right[:1], 90, axis=0), right[:40] * (1 + 1e-9)]) * scale
    left = np.concatenate([right[:200], rng.normal(size=(50, 6)), np.zeros((2, 6))])
    own = np.concatenate([np.arange(200), np.full(52, -1)])
    best, value = P.best_places(left, right, own, -np.inf)
    want, most = P._best_in_double(left, right, own)
    assert best.tolist() == want.tolist()
    assert np.allclose(value, most, rtol=1e-12, atol=0)
    over = float(np.median(value))
    some = P.best_places(left, right, own, over)
    ok = value > over
    assert some[0][ok].tolist() == best[ok].tolist() and (some[1][ok] == value[ok]).all()
