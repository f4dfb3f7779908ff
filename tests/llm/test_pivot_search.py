import random

import pytest
from pyspark.sql import functions as F

from clanmark.llm.pivot_search import scaled, top_inner_products


def brute(rows, k, every):
    out = []
    for q, v in rows:
        if q is None or v is None or q % every or not v:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and w and i != q and len(w) == len(v)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [1, 8 << 20])
def test_against_brute_force(spark, query_bytes):
    draw = random.Random(2)
    rows = [(i, [draw.randint(-3, 3) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 180)] + [(200, None), (None, [1] * 6), (210, []), (220, [1, 2]), (221, [3, 4]), (222, [0, 1])]
    rows += [(300 + i, [0] * 6) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5)
    got = top_inner_products(df, F.col("vec_id") % 20 == 0, 10, pivots=4, query_bytes=query_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 20)


def test_large_values_and_few_rows(spark):
    draw = random.Random(5)
    rows = [(i, [draw.randint(-200_000, 200_000) for _ in range(16)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert sorted(map(tuple, top_inner_products(df, F.col("vec_id") % 7 == 0, 5).collect())) == brute(rows, 5, 7)
    few = df.limit(1)
    assert top_inner_products(few, F.lit(True), 5).count() == 0
    assert top_inner_products(df.limit(0), F.lit(True), 5).count() == 0


def test_scaled_leaves_out_what_is_not_finite(spark):
    rows = [([0.5, -0.25, 1e-9],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>").select(scaled("v").alias("s"))
    assert [r.s for r in df.collect()] == [[512, -256, 0], None, None, None, None, []]


def test_other_lengths_with_more_rows_than_k(spark):
    draw = random.Random(8)
    rows = [(i, [draw.randint(-9, 9) for _ in range(6)]) for i in range(200)]
    rows += [(1000 + i, [draw.choice((-1000, 1000)), draw.randint(-3, 3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = top_inner_products(df, F.col("vec_id") % 20 == 0, 5, pivots=4)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_beyond_doubles(spark):
    draw = random.Random(9)
    rows = [(i, [draw.randint(-30_000 * 1024, 30_000 * 1024) | 1 for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, [v + (i % 3) for v in rows[0][1]]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    got = top_inner_products(df, F.col("vec_id") % 50 == 0, 10, pivots=6)
    want = brute(rows, 10, 50)
    assert sorted(map(tuple, got.collect())) == want and max(r[3] for r in want) > 1 << 53
