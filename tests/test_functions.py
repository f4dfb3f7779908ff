import hashlib
import math
import os
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from clanmark.functions import paths as P
from clanmark.functions import quality as Q
from clanmark.functions import vectors as V

NAMES = [
    "My Batch 1", "__A__b__", "", "café.PNG", "___", "x.y.z.jpeg", ".hidden", "..a.b", "a.", "a/b.c/d",
    "dir/.rc", "noext", "user.1@site-2", "日本_語-7", "tab\tname", "a" * 65,
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "n string")


def clean(name):
    if not name:
        return "default"
    out = re.sub(r"_{2,}", "_", re.sub(r"[^a-zA-Z0-9_-]", "_", name)).strip("_")
    return (out or "default").lower()


def test_clean_names(names):
    rows = names.select("n", P.clean_path_component(F.col("n")).alias("c"), P.clean_filename(F.col("n")).alias("f"))
    for r in rows.collect():
        assert r.c == clean(r.n)
        stem, ext = os.path.splitext(r.n)
        assert r.f == ("file.jpg" if not r.n else clean(stem) + (ext or ".jpg"))


def test_user_ids(names):
    rows = names.select("n", P.valid_user_id(F.col("n")).alias("a"), P.valid_path_id(F.col("n")).alias("p")).collect()
    for r in rows:
        assert r.a == bool(re.match(r"^[\w\-\.@]{1,64}$", r.n))
        assert r.p == bool(re.match(r"^[a-zA-Z0-9_-]+$", r.n))
    assert any(r.a for r in rows) and not all(r.a for r in rows)


def test_point_id_is_uuid5(spark):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("i"), P.point_id(F.col("id").cast("string"), F.lit("run é")).alias("p")
    )
    for r in rows.collect():
        assert r.p == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r.i}_run é"))


def test_surrogate_ids(spark):
    df = spark.createDataFrame([("a@b.c", "x"), (None, "x"), ("", "x"), (None, None)], "e string, n string")
    got = [r[0] for r in df.select(P.surrogate_user_id(F.col("e"), F.col("n"))).collect()]
    hashed = ["user_" + hashlib.md5(t.encode()).hexdigest()[:12] for t in ("a@b.c", "x", "x")]
    assert got[:3] == hashed and uuid.UUID(got[3])


def test_parse_asset_path(spark):
    keys = ["anonymous-images/b", "anonymous-images/b/x.jpg", "user-profiles/u", "user-profiles/u/p.png",
            "temp-uploads/s/a/b.png", "temp-uploads/s", "other/x", "single", "/user-profiles/u/"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [tuple(r.p) for r in df.select(P.parse_asset_path(F.col("k")).alias("p")).collect()]
    assert got == [
        ("anonymous-images", None, "b", None, "b", True, False, False),
        ("anonymous-images", None, "b", None, "x.jpg", True, False, False),
        ("user-profiles", None, None, "u", "profile.jpg", False, True, False),
        ("user-profiles", None, None, "u", "p.png", False, True, False),
        ("temp-uploads", "s", None, None, "b.png", False, False, True),
        ("temp-uploads", "s", None, None, "s", False, False, True),
        ("other", None, None, None, None, False, False, False),
        (None, None, None, None, None, False, False, False),
        ("user-profiles", None, None, "u", "profile.jpg", False, True, False),
    ]


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05",), ("soon",), (None,)], "t string")
    at, bad = P.coerce_timestamp(F.col("t"))
    got = df.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("a"), bad.alias("b")).collect()
    assert [tuple(r) for r in got] == [
        ("2024-01-02 03:04:05", False), ("2024-01-02 03:04:05", False), (None, True), (None, False)
    ]


def test_run_table_name_is_one_derivation(spark):
    df = spark.createDataFrame([("My-Bucket", "sub-one/two")], "b string, s string")
    assert df.select(P.run_table_name("runs", F.col("b"), F.col("s"))).first()[0] == "runs_my_bucket_sub_one_two"


def test_vector_functions(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 7)), rng.normal(size=(50, 7))
    a[0] = 0
    b[1] = a[1]
    b[2] = -a[2]
    rows = [([float(x) for x in u], [float(x) for x in v]) for u, v in zip(a, b)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(
        V.cosine_similarity("a", "b").alias("cos"), V.cosine_distance_abs("a", "b").alias("dabs"),
        V.cosine_distance_xy("a", "b").alias("dxy"), V.euclidean_distance("a", "b").alias("eu"),
        V.l2_normalize("a").alias("unit"), V.standardize("a").alias("std"),
    ).collect()
    for i, r in enumerate(got):
        na, nb, d = np.linalg.norm(a[i]), np.linalg.norm(b[i]), float(a[i] @ b[i])
        cos = d / (na * nb) if na and nb else 0.0
        assert math.isclose(r.cos, cos, abs_tol=1e-12)
        assert r.dabs is None if not na else math.isclose(r.dabs, 1 - abs(cos), abs_tol=1e-12)
        assert math.isclose(r.dxy, 1 - d / ((na + 1e-12) * (nb + 1e-12)), abs_tol=1e-9)
        assert math.isclose(r.eu, np.linalg.norm(a[i] - b[i]))
        assert np.allclose(r.unit, a[i] / na if na else a[i])
        spread = max(a[i].std(), 1 / np.sqrt(len(a[i])))
        assert np.allclose(r.std, (a[i] - a[i].mean()) / spread)


def test_means(spark):
    rows = [(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 2.0]), (3, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    means = {r.k: (r["size"], r.centroid) for r in V.mean_vectors(df, ["k"], "v").collect()}
    assert means == {1: (2, [2.0, 4.0]), 2: (1, [0.0, 2.0]), 3: (1, [None, None])}
    units = {r.k: r.centroid for r in V.unit_centroids(df, ["k"], "v").collect()}
    assert np.allclose(units[1], np.array([2, 4]) / np.sqrt(20)) and units[2] == [0.0, 1.0] and units[3] == [0.0, 0.0]


def test_mean_of_variants(spark):
    rows = [(1, None, [2.0]), (1, 0, [2.0]), (1, 1, [5.0]), (1, 2, None), (1, 4, [99.0]), (2, 0, [1.0]), (3, None, [7.0])]
    df = spark.createDataFrame(rows, "i long, n int, v array<double>")
    got = {r.i: (r.n_vectors, r.centroid) for r in V.mean_of_variants(df, "i", "n", "v", limit=4).collect()}
    assert got == {1: (3, [3.0]), 3: (1, [7.0])}
    assert V.mean_of_variants(df, "i", "n", "v").where("i = 1").first().n_vectors == 4


def test_quality_scores_and_gate(spark):
    df = spark.createDataFrame(
        [(0.9, 40, 50, 100.0), (0.0, 40, 50, 100.0), (None, 40, 50, 100.0), (0.3, 10, 50, 20.0)],
        "c double, w int, h int, b double",
    )
    area = [r[0] for r in df.select(Q.quality_area(F.col("c"), F.col("w"), F.col("h"))).collect()]
    assert area == [0.9 * 2000, None, None, 0.3 * 500]
    gate = Q.gate(F.col("w"), F.col("h"), F.col("c"), F.col("b"), F.lit(30), F.lit(0.5), F.lit(80.0))
    rows = df.select(gate[0].alias("ok"), gate[2].alias("why")).collect()
    assert rows[0].ok and rows[0].why == ""
    assert not rows[3].ok and rows[3].why == "size,confidence,blur"
    checks = df.select(gate[1].alias("c")).collect()[3].c
    assert checks == ["size:10:30", "confidence:0.300:0.500", "blur:20.00:80.00"]


def test_vectors_of_an_unusual_length_count_only_in_size(spark):
    rows = [(1, []), (1, [9.0]), (1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, None), (2, [1.0] * 5), (2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").coalesce(1)
    assert V.dimension_of(df, "v") == 2 and V.dimension_of(df.limit(1), "v") == 0
    got = {r.k: (r.size, r.centroid) for r in V.mean_vectors(df, ["k"], "v").collect()}
    assert got == {1: (5, [2.0, 3.0]), 2: (2, [5.0, 5.0])}
