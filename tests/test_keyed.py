"""Keyed tables: the same rows as whole-table operators, only touched files replaced, few files opened."""

import os

import pytest
from pyspark.sql import functions as F

from clanmark.operators import assign, maintain
from clanmark.sources import keyed as K

def at():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def files(folder):
    """Data files with their times."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def plain(df):
    return sorted((tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


def profiles(spark, n=400):
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    users = F.format_string("user_%04d", "id").alias("user_id")
    return spark.range(n).select(
        users, F.array(F.col("id") * 1.0, F.lit(1.0)).alias("embedding"), (F.col("id") / n).alias("confidence"), then.alias("created_at"), then.alias("updated_at")
    )


def members(spark, n=600):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("detection_id"), F.concat(F.lit("0"), (i % 3).cast("string")).alias("run_id"), (i % 7).cast("string").alias("person_id"), (i % 5 == 0).alias("is_owner")
    )


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "table")


def test_a_patch_replaces_only_the_buckets_of_its_keys(spark, place):
    table = K.create(profiles(spark), K.KeyedTable(place, ("user_id",), buckets=32))
    before = files(place)
    rows = [("user_0007", None, 0.5, 1), ("user_0100", [9.0, 9.0], None, 1), ("new_1", [1.0, 2.0], 0.1, 1), ("new_1", None, 0.2, 2)]
    patch = spark.createDataFrame(rows, "user_id string, embedding array<double>, confidence double, version int")
    touched = K.upsert_profiles(spark, table, patch, at(), "version")
    assert 1 <= len(touched) <= 3
    assert plain(K.rows(spark, table)) == plain(maintain.upsert_profile(profiles(spark), patch, at(), "version"))
    after = files(place)
    here = {f"bucket_of_32={b}" for (b,) in touched}
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if p.split("/")[-2] in here}
    assert {p.split("/")[-2] for p in after if p not in before} == here
    again = K.stored(spark, place, ("user_id",))
    assert (again.buckets, again.by) == (32, ())


def test_assignments_by_run_and_cluster(spark, place):
    i = F.col("id")
    then = F.lit("2024-01-01 00:00:00").cast("timestamp")
    old = spark.range(90).select(F.format_string("r%d", i % 3).alias("run_id"), i.alias("cluster_id"), F.lit("u").alias("user_id"), (i / 90).alias("similarity"), then.alias("created_at"), then.alias("updated_at"))
    new = spark.createDataFrame([("r1", 4, "v", 0.9), ("r1", 4, "w", 0.9), ("r1", 1000, "v", 0.5), ("r7", 1, "v", 0.5)], "run_id string, cluster_id long, user_id string, similarity double")
    table = K.create(old, K.KeyedTable(place, ("run_id", "cluster_id"), ("run_id",), 8))
    before = files(place)
    assert K.upsert_assignments(spark, table, new, at(), dry_run=True) == [] and files(place) == before
    touched = K.upsert_assignments(spark, table, new, at())
    assert {p[0] for p in touched} == {"r1", "r7"} and len(touched) <= 3
    assert plain(K.rows(spark, table)) == plain(assign.assignment_upsert(old, new, at()))
    assert all(files(place)[p] == t for p, t in before.items() if "run_id=r1" not in p)
    assert K.stored(spark, place, table.keys).by == ("run_id",)


def test_members_are_moved_relabelled_stamped_and_deleted(spark, place):
    table = K.create(members(spark), K.KeyedTable(place, ("detection_id",), ("run_id",), 16))
    want = members(spark)
    ids = spark.createDataFrame([(4,), (7,), (7,), (9999,)], "detection_id long")
    K.reassign(spark, table, ids, "01", "x")
    want = maintain.reassign_members(want, ids, "01", "x")
    assert plain(K.rows(spark, table)) == plain(want)
    patch = ids.distinct().withColumn("person_id", F.lit("y"))
    before = files(place)
    touched = K.relabel(spark, table, patch)
    want = maintain.relabel_members(want, patch)
    assert plain(K.rows(spark, table)) == plain(want) and len(touched) == 2
    assert sum(files(place).get(p) != t for p, t in before.items()) <= 2
    K.stamp_run(spark, table, ids, "new run/1")
    want = maintain.stamp_run_id(want, ids, "new run/1")
    assert plain(K.rows(spark, table)) == plain(want)
    one = K.create(spark.createDataFrame([(1, "a"), (2, "b")], "detection_id long, run_id string"), K.KeyedTable(place + "2", ("detection_id",), ("run_id",), 4))
    K.delete_keys(spark, one, spark.createDataFrame([(1,)], "detection_id long"))
    assert plain(K.rows(spark, one)) == [("2", "b")] and not os.path.exists(place + "2/run_id=a/bucket_of_4=" + str(spark.sql("select pmod(xxhash64(1L), 4) b").first().b))
    assert K.delete_keys(spark, one, spark.createDataFrame([], "detection_id long")) == []


def metric(df, name):
    """A scan metric of a collected plan without exchanges."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply(name).value()


def test_a_lookup_opens_the_buckets_of_its_keys(spark, place, monkeypatch):
    table = K.create(profiles(spark, 2000), K.KeyedTable(place, ("user_id",), buckets=64))
    keys = spark.createDataFrame([(f"user_{i:04d}",) for i in range(0, 2000, 200)] + [("nobody",)], "user_id string")
    found = K.lookup(spark, table, keys)
    assert sorted(r.user_id for r in found.collect()) == [f"user_{i:04d}" for i in range(0, 2000, 200)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(user_id" in text
    assert metric(found, "numFiles") <= 11 < len(files(place))
    assert K.lookup(spark, table, keys.limit(0)).count() == 0
    monkeypatch.setattr(K, "LISTED_KEYS", 3)
    assert K.lookup(spark, table, keys).count() == 10


def test_lookup_by_two_columns(spark, place):
    table = K.create(members(spark), K.KeyedTable(place, ("run_id", "detection_id"), ("run_id",), 8))
    keys = spark.createDataFrame([("00", 3), ("01", 3), ("02", 5)], "run_id string, detection_id long")
    assert sorted((r.run_id, r.detection_id) for r in K.lookup(spark, table, keys).collect()) == [("00", 3), ("02", 5)]


def test_runs_are_counted_and_dropped_without_reading_rows(spark, place):
    table = K.create(members(spark), K.KeyedTable(place, ("detection_id",), ("run_id",), 4))
    others = {p: t for p, t in files(place).items() if "run_id=01" not in p}
    counts = K.counted(spark, table, run_id="01")
    assert counts.collect()[0]["rows"] == 200 and "PushedAggregation: [COUNT(*)]" in counts._jdf.queryExecution().executedPlan().toString()
    report = K.cleanup_run(spark, table, table, "01", dry_run=True).collect()
    assert [(r.found, r.deleted) for r in report] == [(200, 0), (200, 0)] and K.counted(spark, table).first()["rows"] == 600
    assert K.drop_where(spark, table, run_id="01") == 200 and files(place) == others
    assert K.drop_where(spark, table, run_id="01") == 0 and K.counted(spark, table).first()["rows"] == 400
    none = K.create(members(spark, 0), K.KeyedTable(place + "0", ("detection_id",), ("run_id",), 4))
    assert K.counted(spark, none).first()["rows"] == 0 == K.inspect(spark, none).first()["row_count"] == K.rows(spark, none).count()
    with pytest.raises(ValueError):
        K.drop_where(spark, table, person_id="1")


def test_inspection_reads_footers(spark, place):
    from clanmark.sources.tables import inspect_table

    rows = profiles(spark).withColumnRenamed("embedding", "owner_embedding")
    table = K.create(K.with_length(rows, "owner_embedding"), K.KeyedTable(place, ("user_id",), buckets=4))
    found = K.inspect(spark, table)
    assert plain(found) == plain(inspect_table(rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MAX(dims)" in plan and "COUNT(*)" in plan and "owner_embedding#" not in plan.split("Scan")[-1]
