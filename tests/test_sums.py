"""Vector sums against numpy: ragged rows, hot keys, several keys, wide vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clanmark.functions import sums as S
from clanmark.functions import vectors as V


def brute(rows, dim):
    out = {}
    for *key, v in rows:
        total, n = out.get(tuple(key), (np.zeros(dim), 0))
        if v is not None and len(v) == dim:
            total = total + np.array([x or 0.0 for x in v])
        out[tuple(key)] = (total, n + 1)
    return out


@pytest.mark.parametrize("held", [S.HELD, 30])
def test_against_numpy(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, None, 7]), draw.choice(["a", "b", None]), [draw.random() for _ in range(5)]) for _ in range(400)]
    rows += [(1, "a", None), (1, "a", []), (9, "x", [1.0]), (2, "b", [None, 1.0, 2.0, 3.0, 4.0]), (2, "b", [1.0] * 6)]
    rows += [(1, "hot", [1.0, 2.0, 3.0, 4.0, 5.0])] * 500
    df = spark.createDataFrame(rows, "k long, s string, v array<double>").repartition(5)
    got = S.vector_sums(df, ["k", "s"], "v", 5, {"n": F.lit(1).cast("long")}).collect()
    want = brute(rows, 5)
    assert len(got) == len(want) and {(r.k, r.s) for r in got} == set(want)
    for r in got:
        total, n = want[r.k, r.s]
        assert r.n == n and np.allclose(r._sum, total)


def test_few_rows_leave_a_task_for_a_hot_key(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("v")).repartition(4)
    parts = df.select("k", F.col("v").alias("_sum")).mapInArrow(S._before_shuffle(["k"], [], 2), "k long, _sum array<double>")
    assert parts.count() <= 3 * 4
    assert {r.k: r.centroid[0] for r in V.mean_vectors(df, ["k"], "v").collect()} == {0: 1.0, 1: 1.0, 2: 1.0}


def test_the_plan_does_not_grow_with_the_dimension(spark):
    def plan(dim):
        df = spark.range(10).select("id", F.array_repeat(F.col("id") * 1.0, dim).alias("v"))
        return S.vector_sums(df, ["id"], "v", dim)._jdf.queryExecution().executedPlan().toString()

    assert abs(len(plan(1024)) - len(plan(4))) < 200


def test_empty_tables_and_odd_keys(spark):
    df = spark.createDataFrame([], "k long, v array<double>")
    assert V.mean_vectors(df, ["k"], "v").count() == 0
    rows = [(f"k{i % 4}", [float(i)] * 1024) for i in range(40)]
    wide = spark.createDataFrame(rows, "`k` string, v array<double>")
    got = {r.k: r.centroid for r in V.mean_vectors(wide, ["k"], "v").collect()}
    assert all(len(c) == 1024 and np.allclose(c, 18.0 + int(k[1])) for k, c in got.items()) and len(got) == 4
