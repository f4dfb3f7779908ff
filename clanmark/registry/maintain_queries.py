"""Validation, upserts, updates and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from clanmark.operators import maintain as O
from clanmark.plans.entities import admit_profiles as admit
from clanmark.registry import inputs as I
from clanmark.registry.assign_queries import at, stamp
from clanmark.registry.base import checksum, checksum_sql, query
from clanmark.registry.filter_queries import PASSED
from clanmark.registry.sqltext import define


@query(
    "validate_profile",
    """SELECT k, reasons, reasons = '' AS is_valid FROM (SELECT k, concat_ws(',',
 CASE WHEN user_id LIKE '% %' THEN 'user_id_characters' END, CASE WHEN len(user_id) < 3 OR len(user_id) > 64 THEN 'user_id_length' END,
 CASE WHEN len(embedding) < 64 THEN 'embedding_dimensions' END, CASE WHEN confidence > 1 OR confidence < 0 THEN 'confidence_range' END,
 CASE WHEN quality_score < 0 THEN 'quality_range' END, CASE WHEN len(bbox) <> 4 THEN 'bbox_length' END) AS reasons FROM submitted)""",
)
def validate_profile(spark, d):
    judged = O.validate_profile(I.submitted_profiles(spark, d), min_dims=64)
    return judged.select("k", F.array_join("reasons", ",").alias("reasons"), "is_valid")


define(
    "patch",
    """SELECT CASE WHEN k % 3 = 0 THEN user_id ELSE 'new_' || user_id END AS user_id,
 CASE WHEN k % 2 = 0 THEN embedding END AS embedding, CASE WHEN k % 5 <> 0 THEN 0.99::DOUBLE WHEN k % 10 = 0 THEN 0.25::DOUBLE END AS confidence,
 quality_score + 1 AS quality_score FROM profiles""",
)


def stored_profiles(spark, d):
    base = I.profiles(spark, d).select("user_id", "embedding", "confidence", "quality_score")
    return base.withColumns({"created_at": at("2024-01-01 00:00:00"), "updated_at": at("2024-01-01 00:00:00")})


def profile_patch(spark, d):
    """Every third profile changed, the others under new ids; two versions per key that disagree."""
    k = F.substring("user_id", 6, 6).cast("long")
    base = I.profiles(spark, d).withColumn("k", k).select(
        F.when(F.col("k") % 3 == 0, F.col("user_id")).otherwise(F.concat(F.lit("new_"), "user_id")).alias("user_id"),
        F.when(F.col("k") % 2 == 0, F.col("embedding")).alias("embedding"),
        F.when(F.col("k") % 5 != 0, F.lit(0.99)).alias("confidence"),
        (F.col("quality_score") + 1).alias("quality_score"),
        F.lit(2).alias("version"),
        "k",
    )
    before = F.when(F.col("k") % 10 == 0, F.lit(0.25)).when(F.col("k") % 5 != 0, F.lit(0.1))
    older = base.withColumns({"quality_score": F.lit(-5.0), "confidence": before, "version": F.lit(1)})
    return base.unionByName(older).drop("k")


@query(
    "upsert_profile",
    f"""SELECT coalesce(p.user_id, n.user_id) AS user_id, {checksum_sql("v")} AS weighted, round(c, 6) AS confidence, q AS quality_score,
 CASE WHEN p.user_id IS NULL THEN '2024-03-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS created_at,
 CASE WHEN n.user_id IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-03-01 00:00:00' END AS updated_at
FROM (SELECT p, n, coalesce(n.embedding, p.embedding) AS v, coalesce(n.confidence, p.confidence) AS c,
 coalesce(n.quality_score, p.quality_score) AS q FROM profiles p FULL JOIN patch n ON p.user_id = n.user_id)""",
)
def upsert_profile(spark, d):
    merged = O.upsert_profile(
        stored_profiles(spark, d), profile_patch(spark, d), at("2024-03-01 00:00:00"), order="version"
    )
    return merged.select(
        "user_id", checksum("embedding").alias("weighted"), "confidence", "quality_score", stamp("created_at"), stamp("updated_at")
    )


@query(
    "profile_lookup",
    """SELECT 'get' AS call, user_id FROM profiles WHERE user_id = 'user_000003'
UNION ALL (SELECT 'list', user_id FROM profiles ORDER BY user_id LIMIT 10)
UNION ALL SELECT 'delete', user_id FROM profiles WHERE user_id NOT IN (SELECT user_id FROM patch)""",
)
def profile_lookup(spark, d):
    stored = stored_profiles(spark, d)
    parts = [
        ("get", O.get_profile(stored, "user_000003")),
        ("list", O.list_profiles(stored, 10)),
        ("delete", O.without_keys(stored, profile_patch(spark, d), ["user_id"])),
    ]
    slim = [part.select(F.lit(name).alias("call"), "user_id") for name, part in parts]
    return reduce(lambda a, b: a.unionByName(b), slim)


def listed(spark, d):
    """The detections that own a cluster of the first clustering."""
    owners = I.clusters(spark, d).where(F.col("run_id").startswith("r1"))
    return owners.select(F.col("owner_id").alias("detection_id"))


LISTED = "(SELECT owner_id FROM clusters WHERE run_id LIKE 'r1%')"


@query(
    "reassign_members",
    f"""SELECT run_id, detection_id, CASE WHEN hit THEN 'person_x' ELSE person_id END AS person_id, is_owner AND NOT hit AS is_owner
FROM (SELECT *, run_id = 'r2a' AND detection_id IN {LISTED} AS hit FROM members)""",
)
def reassign_members(spark, d):
    moved = O.reassign_members(I.points(spark, d), listed(spark, d), "r2a", "person_x")
    return moved.select("run_id", "detection_id", "person_id", "is_owner")


@query(
    "relabel_members",
    f"""SELECT run_id, detection_id, CASE WHEN detection_id IN {LISTED} THEN 'moved_' || detection_id ELSE person_id END AS person_id FROM members""",
)
def relabel_members(spark, d):
    label = F.concat(F.lit("moved_"), F.col("detection_id").cast("string"))
    patch = listed(spark, d).distinct().withColumn("person_id", label)
    return O.relabel_members(I.points(spark, d), patch).select("run_id", "detection_id", "person_id")


@query(
    "stamp_run_id",
    f"""SELECT detection_id, CASE WHEN detection_id IN {LISTED} THEN 'r9' ELSE run_id END AS run_id, cluster_id FROM members""",
)
def stamp_run_id(spark, d):
    stamped = O.stamp_run_id(I.points(spark, d), listed(spark, d), "r9")
    return stamped.select("detection_id", "run_id", "cluster_id")


@query(
    "delete_rows",
    f"""SELECT 'face' AS by, run_id, detection_id, 0::BIGINT AS deleted FROM members WHERE detection_id NOT IN {LISTED}
UNION ALL SELECT 'run', run_id, detection_id, 0 FROM members WHERE run_id <> 'r1a'
UNION ALL SELECT 'person', run_id, detection_id, 0 FROM members WHERE NOT (run_id = 'r2b' AND person_id = 'unassigned')
UNION ALL SELECT 'place', run_id, detection_id, 0 FROM members WHERE sub_bucket <> 'b'
UNION ALL SELECT 'count', NULL, NULL, count(*) FROM members WHERE run_id = 'r1a'""",
)
def delete_rows(spark, d):
    points = I.points(spark, d)
    of_run, count = O.delete_where(points, F.col("run_id") == "r1a")
    parts = [
        ("face", O.without_keys(points, listed(spark, d), ["detection_id"])),
        ("run", of_run),
        ("person", O.delete_where(points, (F.col("run_id") == "r2b") & (F.col("person_id") == "unassigned"))[0]),
        ("place", O.delete_where(points, F.col("sub_bucket") == "b")[0]),
    ]
    zero = F.lit(0).cast("long").alias("deleted")
    slim = [part.select(F.lit(name).alias("by"), "run_id", "detection_id", zero) for name, part in parts]
    none = F.lit(None)
    total = count.select(
        F.lit("count").alias("by"), none.cast("string").alias("run_id"), none.cast("long").alias("detection_id"), "deleted"
    )
    return reduce(lambda a, b: a.unionByName(b), [*slim, total])


@query(
    "cleanup_run",
    """SELECT 'assignments' AS step, count(*) AS found, count(*) AS deleted, TRUE AS success,
  (SELECT count(*) FROM assignments WHERE run_id <> 'r1a') AS left_over FROM assignments WHERE run_id = 'r1a'
UNION ALL SELECT 'vectors', count(*), count(*), TRUE, (SELECT count(*) FROM members WHERE run_id <> 'r1a') FROM members WHERE run_id = 'r1a'
UNION ALL SELECT 'assignments_dry', count(*), 0, TRUE, (SELECT count(*) FROM assignments) FROM assignments WHERE run_id = 'r1a'
UNION ALL SELECT 'vectors_dry', count(*), 0, TRUE, (SELECT count(*) FROM members) FROM members WHERE run_id = 'r1a'""",
)
def cleanup_run(spark, d):
    def reported(dry: bool):
        a, p, report = O.cleanup_run(I.assignments(spark, d), I.points(spark, d), "r1a", dry)
        left = a.agg(F.count(F.lit(1)).alias("left_over")).withColumn("step", F.lit("assignments")).unionByName(
            p.agg(F.count(F.lit(1)).alias("left_over")).withColumn("step", F.lit("vectors"))
        )
        joined = report.join(left, "step")
        suffix = F.lit("_dry" if dry else "")
        return joined.withColumn("step", F.concat("step", suffix))

    return reported(False).unionByName(reported(True))


define(
    "admitted",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY asset_id DESC) AS n FROM (
 SELECT sub AS asset_id, 'user_' || lpad((sub // 20)::VARCHAR, 6, '0') AS user_id, any_value(vector) AS v,
  min(confidence) AS confidence, min(w) AS w, min(h) AS h, min(blur) AS blur
 FROM (SELECT *, detection_id * detection_id % (SELECT count(*) FROM e) AS sub FROM det) GROUP BY sub
 HAVING count(*) = 1 AND sub % 7 <> 1) WHERE {PASSED.format(size=30, sure=0.4, blur=50)}) WHERE n = 1""",
)


@query(
    "admit_profiles",
    f"""SELECT user_id, {checksum_sql("v")} AS weighted, round(c, 6) AS confidence, round(q, 6) AS quality_score, created_at, updated_at
FROM (SELECT coalesce(p.user_id, n.user_id) AS user_id, coalesce(n.v, p.embedding) AS v, coalesce(n.confidence, p.confidence) AS c,
 coalesce(n.confidence * n.w * n.h, p.quality_score) AS q,
 CASE WHEN p.user_id IS NULL THEN '2024-03-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS created_at,
 CASE WHEN n.user_id IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-03-01 00:00:00' END AS updated_at
 FROM profiles p FULL JOIN admitted n ON p.user_id = n.user_id)""",
)
def admit_profiles(spark, d):
    """Submissions of one picture each: twenty per user, every seventh under a bad id."""
    embeddings = I.embeddings(spark, d)
    i, asset = F.col("detection_id"), F.col("vec_id")
    shots = I.detections(spark, d).withColumn("asset_id", i * i % F.lit(embeddings.count()))
    user = F.concat(F.lit("user_"), F.lpad(F.expr("vec_id div 20").cast("string"), 6, "0"))
    submissions = embeddings.select(asset.alias("asset_id"), F.when(asset % 7 == 1, "x").otherwise(user).alias("user_id"))
    stored, _ = admit(submissions, shots, stored_profiles(spark, d), at("2024-03-01 00:00:00"), min_dims=64)
    return stored.select(
        "user_id", checksum("embedding").alias("weighted"), "confidence", "quality_score", stamp("created_at"), stamp("updated_at")
    )
