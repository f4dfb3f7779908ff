import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from clanmark.operators import assign as A
from clanmark.operators import filters as O
from clanmark.operators import maintain as M
from clanmark.operators import summary as Y
from clanmark.operators.numbering import number_rows, rank_within
from clanmark.plans import entities as E
from clanmark.registry import load
from clanmark.sources import assets, tables
from clanmark.sources.workspace import materialize, work_folder
from tests import samples as X


def at(text):
    return F.lit(text).cast("timestamp")


def test_intermediate_tables_go_to_the_work_folder(spark):
    stored = materialize(spark.range(5))
    assert stored.count() == 5 and stored.inputFiles()[0].startswith(f"file://{work_folder(spark)}/")


def test_numbers_and_ranks_over_a_hot_key(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    numbered = number_rows(df.repartition(6), [F.asc("k"), F.desc("id")], "n", start=1)
    expected = sorted(((r.k, r.id) for r in df.collect()), key=lambda t: (t[0], -t[1]))
    got = sorted((r.n, r.k, r.id) for r in numbered.collect())
    assert got == [(i + 1, *t) for i, t in enumerate(expected)]
    ranked = rank_within(df, ["k"], [F.desc("id")]).collect()
    seen = {}
    for r in sorted(ranked, key=lambda r: (r.k, -r.id)):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r["rank"] == seen[r.k]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "members")
    first = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "run_id string, detection_id long")
    tables.write_detections(first, path)
    again = spark.createDataFrame([("r1", 9)], "run_id string, detection_id long")
    tables.write_detections(again, path)
    assert sorted((r.run_id, r.detection_id) for r in tables.read_table(spark, path).collect()) == [("r1", 9), ("r2", 3)]


def test_pages_hold_every_member_of_a_large_cluster(spark):
    df = spark.range(2500).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") < 2300, 1).otherwise(2).alias("cluster_id"),
        F.col("id").alias("detection_id"), (F.col("id") % 9).alias("asset_id"),
        F.lit(0.5).alias("confidence"), F.lit(1.0).alias("quality"),
    )
    pages = tables.cluster_pages(df, page_rows=100).collect()
    assert max(len(p.members) for p in pages) <= 100
    held = [(p.cluster_id, m.detection_id) for p in pages for m in p.members]
    assert len(held) == 2500 and set(held) == {(1 if i < 2300 else 2, i) for i in range(2500)}


def test_pages_follow_each_other(spark):
    df = spark.range(25_000).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") % 5 == 0, F.col("id") % 2).alias("cluster_id"),
        (F.col("id") * 7919 % 25_000).alias("detection_id"), F.lit(1).alias("asset_id"),
        F.lit(0.5).alias("confidence"), F.lit(1.0).alias("quality"),
    ).repartition(5)
    pages = {(p.cluster_id, p.page_no): [m.detection_id for m in p.members] for p in tables.cluster_pages(df, page_rows=100).collect()}
    for cluster, count in ((None, 20_000), (0, 2_500), (1, 2_500)):
        numbers = sorted(n for c, n in pages if c == cluster)
        assert numbers == list(range(count // 100))
        ids = [i for n in numbers for i in pages[cluster, n]]
        assert ids == sorted(ids) and len(set(ids)) == count


def embeddings_of(spark, folder, ids, matrix):
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, matrix)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_a_cluster_of_several_pages_is_one_row(spark, tmp_path):
    """Both runs have a cluster of more than 1 000 members per sub-bucket."""
    rng = np.random.default_rng(2)
    ids = np.arange(2400)
    folder = embeddings_of(spark, tmp_path, ids, rng.normal(size=6) + 0.01 * rng.normal(size=(2400, 6)))
    asset = np.where(ids // 10 % 5 == 0, ids // 10 + 1000, ids * 7 % 60)
    expected = set()
    for kind, own in (("a", ids[asset % 2 == 0]), ("b", ids[asset % 2 == 1])):
        assert len(own) > 1000
        expected |= {(run + kind, 0, len(own), ",".join(map(str, own))) for run in ("r1", "r2")}
    assert sorted(tuple(r) for r in load().QUERIES["cluster_pages"](spark, folder).collect()) == sorted(expected)


@pytest.mark.parametrize("name", ["cluster_pages", "cluster_pages_small"])
def test_pages_of_runs_without_clusters(spark, tmp_path, name):
    """Single rows are unassigned in the second run, which then has no cluster at all."""
    folder = embeddings_of(spark, tmp_path, range(0, 240, 10), np.eye(24))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.execute(load().ORACLES[name]).df()
    assert set(want.run_id) == {"r1a", "r1b", "r2a", "r2b"}
    got = load().QUERIES[name](spark, folder).toPandas()
    assert check.normal(got) == check.normal(want)


def test_extract_clusters_of_every_layout(spark):
    a, b = {"person_id": "a", "size": 1}, {"person_id": "b", "owner_embedding": [0.5]}
    documents = [
        {"person_clusters": [a, b], "clusters": [b]},
        {"person_clusters": {"0": a, "1": b, "3": a}},
        {"clusters": [b]},
        [a, b],
        {"0": a, "2": b},
        {"unassigned_faces": [{"cluster_id": "z"}], "tags": ["x"], "found": [b, a]},
        {"nothing": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "k long, doc string")
    rows = tables.extract_clusters(df, "k", "doc").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.k, r.position or 0)):
        if r.cluster is None:
            assert (r.k, r.layout) == (6, "none")
            continue
        got.setdefault(r.k, []).append(r.cluster.person_id)
    assert got == {0: ["a", "b"], 1: ["a", "b"], 2: ["b"], 3: ["a", "b"], 4: ["a"], 5: ["b", "a"]}


def test_assets_from_files(spark, tmp_path):
    for name in ("b/x.JPG", "b/y.txt", "b/c/z.webp"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"12345")
    found = assets.read_assets(spark, str(tmp_path))
    prefix = f"file:{tmp_path}/b/"
    keys = found.withColumn("key", F.regexp_replace("key", "^file:/+", "file:/"))
    assert sorted(r.key[len(prefix):] for r in assets.list_assets(keys, prefix).collect()) == ["c/z.webp", "x.JPG"]
    assert assets.size_guard(found, 4).count() == 0 and assets.size_guard(found, 5).count() == 3


def test_upsert_keeps_what_is_null_and_the_creation_time(spark):
    fields = "user_id string, confidence double, embedding array<double>"
    current = spark.createDataFrame([("a", 0.5, [1.0]), ("b", 0.6, [2.0])], fields).withColumns(
        {"created_at": at("2024-01-01"), "updated_at": at("2024-01-01")}
    )
    new = spark.createDataFrame([("a", None, [9.0], 2), ("a", 0.1, [8.0], 1), ("c", 0.7, None, 1)], fields + ", v int")
    rows = {r.user_id: r for r in M.upsert_profile(current, new, at("2024-02-02"), order="v").collect()}
    assert (rows["a"].confidence, rows["a"].embedding) == (0.1, [9.0])  # each field's last value
    assert rows["a"].created_at < rows["a"].updated_at and rows["b"].created_at == rows["b"].updated_at
    assert rows["c"].created_at == rows["c"].updated_at > rows["a"].created_at and len(rows) == 3


def test_assignment_upsert_modes(spark):
    fields = "run_id string, cluster_id long, user_id string"
    current = spark.createDataFrame([("r", 1, "u"), ("r", 2, "u"), ("s", 1, "u")], fields).withColumns(
        {"created_at": at("2024-01-01"), "updated_at": at("2024-01-01")}
    )
    new = spark.createDataFrame([("r", 1, "w"), ("r", 1, "x"), ("r", 5, "w")], fields)
    merged = A.assignment_upsert(current, new, at("2024-02-02"))
    assert sorted((r.run_id, r.cluster_id, r.user_id) for r in merged.collect()) == [
        ("r", 1, "w"), ("r", 2, "u"), ("r", 5, "w"), ("s", 1, "u")
    ]
    over = A.assignment_upsert(current, new, at("2024-02-02"), overwrite=True)
    assert sorted((r.run_id, r.cluster_id) for r in over.collect()) == [("r", 1), ("r", 5), ("s", 1)]
    assert A.assignment_upsert(current, new, at("2024-02-02"), dry_run=True).count() == 3


def test_empty_run_stats_and_owner_of_null_quality(spark):
    fields = "cluster_id long, detection_id long, asset_id long, confidence double, quality double"
    empty = spark.createDataFrame([], fields)
    assert tuple(Y.run_stats(empty).first()) == (0, 0, 0, 0, 0.0)
    rows = spark.createDataFrame([(1, 5, 0, 0.5, None), (1, 3, 0, 0.5, None), (1, 9, 0, 0.4, None)], fields)
    assert Y.select_owner(rows, ["cluster_id"]).first().owner_id == 3


def test_load_profiles_and_strategies(spark):
    rows = [("a", [3.0, 4.0]), ("b", []), ("c", None), ("d", [0.0, 0.0]), ("e", [float("nan"), 1.0])]
    loaded = A.load_profiles(spark.createDataFrame(rows, "user_id string, embedding array<double>"))
    assert {r.user_id: r.unit for r in loaded.collect()} == {"a": [0.6, 0.8], "d": [0.0, 0.0]}
    owners = spark.createDataFrame([("x", [3.0, 4.0])], "cluster_key string, owner_unit array<double>")
    for strategy in A.STRATEGIES:
        assert [(r.user_id, r.strategy) for r in A.assign_clusters(owners, loaded, strategy=strategy).collect()] == [
            ("a", strategy)
        ]
    with pytest.raises(ValueError):
        A.assign_clusters(owners, loaded, strategy="other")
    with pytest.raises(ValueError):
        A.require_profiles(loaded.where("user_id = 'zz'"))


def test_user_filters(spark):
    rows = [("u", "r1", "p/a", 1, 0.9), ("u", "r2", "p/b", 2, 0.7), ("u", "r3", "q/a", 4, 0.8)]
    df = spark.createDataFrame(rows, "user_id string, run_id string, bucket_path string, face_count long, similarity double")

    def runs(**filters):
        return sorted(r.run_id for r in A.user_assignments_grouped(df, **filters).collect())

    assert runs() == ["r1", "r2", "r3"] and runs(bucket="p") == ["r1", "r2"]
    assert runs(bucket="p", sub_bucket="b") == ["r2"] and runs(sub_bucket="a") == ["r1", "r3"] and runs(run_id="r3") == ["r3"]


def test_reads_prune_columns_and_push_filters(spark, tmp_path):
    path = str(tmp_path / "points")
    matrix, _ = X.planted(rows=20, hot=5)
    df = X.frame(spark, matrix, "detection_id", "unit").withColumns(
        {"run_id": F.lit("r1"), "cluster_id": F.lit(1), "asset_id": F.lit(2), "confidence": F.lit(0.5),
         "quality": F.lit(1.0), "is_owner": F.lit(False), "person_id": F.lit("1")}
    )
    tables.write_partitioned(df, path, ["run_id"])
    plan = Y.cluster_members(tables.read_table(spark, path), "r1", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "PushedFilters: [IsNotNull(cluster_id)" in plan
    assert "unit" not in plan.split("ReadSchema")[1]


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("asset_id"), F.col("id").alias("detection_id"), F.lit(50).alias("w"),
        F.lit(50).alias("h"), (F.col("id") / 100).alias("confidence"),
    )
    plan = O.quality_topk(df, "asset_id", "detection_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_whole_flow(spark):
    matrix, base = X.planted(rows=60, hot=30)
    i = F.col("detection_id")
    detections = X.frame(spark, matrix, "detection_id", "vector").withColumns(
        {"asset_id": i % 40, "confidence": 0.6 + (i % 30) / 100, "w": 40 + i % 7, "h": F.lit(45), "blur": F.lit(200.0)}
    )
    detections = detections.withColumn("quality", F.col("confidence") * F.col("w") * F.col("h"))
    result = E.entities(detections, merge_threshold=0.8).collect()
    assert sum(r.total_detections for r in result) == len(matrix)
    assert [r.total_detections for r in result] == sorted((r.total_detections for r in result), reverse=True)
    assert all(r.owner_id >= r.cluster_id for r in result) and result[0].total_detections > 30

    clusters = spark.createDataFrame(
        [("r1", 1, "p/a", 3, [float(x) for x in base[2]])],
        "run_id string, cluster_id long, bucket_path string, total_detections long, owner_unit array<double>",
    )
    known = spark.createDataFrame([(f"u{k}", [float(x) for x in v]) for k, v in enumerate(base)], "user_id string, embedding array<double>")
    none = spark.createDataFrame(
        [], "run_id string, cluster_id long, user_id string, similarity double, strategy string, face_count long, "
        "bucket_path string, created_at timestamp, updated_at timestamp",
    )
    linked = E.link_users(clusters, known, none, at("2024-01-01")).collect()
    assert [(r.run_id, r.user_id, r.face_count) for r in linked] == [("r1", "u2", 3)]

    submissions = spark.createDataFrame([(100, "ann"), (101, "bob"), (102, "no one"), (103, "dee")], "asset_id long, user_id string")
    shots = detections.where("detection_id < 4").withColumn(
        "asset_id", F.when(i == 0, 100).when(i == 1, 102).otherwise(103).cast("long")
    ).withColumns({"x": F.lit(1), "y": F.lit(2)})
    stored = spark.createDataFrame(
        [], "user_id string, embedding array<double>, confidence double, quality_score double, bbox array<double>, "
        "created_at timestamp, updated_at timestamp",
    )
    profiles, outcome = E.admit_profiles(submissions, shots, stored, at("2024-01-01"), min_dims=12)
    assert {r.asset_id: r.outcome for r in outcome.collect()} == {100: "saved", 101: "no_face", 102: "saved", 103: "multiple"}
    assert [r.user_id for r in profiles.collect()] == ["ann"]  # "no one" fails the id rule
