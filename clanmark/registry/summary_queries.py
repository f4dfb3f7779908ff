"""Roll-ups of clusters, assets, runs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.operators import summary as O
from clanmark.registry import inputs as I
from clanmark.registry.base import query
from clanmark.registry.sqltext import define

KEYS = ["run_id", "cluster_id"]


def clustered(spark, d):
    return I.members(spark, d).where(F.col("cluster_id").isNotNull())


@query(
    "select_owner",
    """SELECT run_id, cluster_id, detection_id AS owner_id, round(score, 6) AS owner_score, asset_id FROM members WHERE is_owner""",
)
def select_owner(spark, d):
    return O.select_owner(clustered(spark, d), KEYS, ("asset_id",))


@query(
    "cluster_profile",
    """SELECT run_id, cluster_id, total_detections, unique_assets, round(avg_confidence, 6) AS avg_confidence,
 round(best_quality, 6) AS best_quality, first_id FROM clusters""",
)
def cluster_profile(spark, d):
    return O.cluster_profile(clustered(spark, d), KEYS)


@query(
    "asset_overlap",
    """SELECT run_id, single_cluster_assets, multi_cluster_assets, max_clusters_per_asset,
 round(avg_clusters_per_asset, 6) AS avg_clusters_per_asset FROM overlap""",
)
def asset_overlap(spark, d):
    return O.asset_overlap(I.members(spark, d), ["run_id"])


@query(
    "unassigned_assets",
    """SELECT DISTINCT asset_id FROM det WHERE asset_id NOT IN (SELECT m.asset_id FROM members m JOIN clusters c USING (run_id, cluster_id)
 WHERE c.total_detections >= 8)""",
)
def unassigned_assets(spark, d):
    """Against the clusters of eight or more detections, so that some assets are left."""
    big = I.clusters(spark, d).where("total_detections >= 8").select(*KEYS)
    return O.unassigned_assets(I.detections(spark, d), I.members(spark, d).join(big, KEYS, "left_semi"))


@query(
    "run_stats",
    """SELECT run_id, count(DISTINCT cluster_id) AS total_clusters, count(DISTINCT asset_id) AS total_assets, count(*) AS total_detections,
 count(*) FILTER (cluster_id IS NULL) AS unassigned_detections,
 round(count(cluster_id) / count(DISTINCT cluster_id), 6) AS avg_per_cluster FROM members GROUP BY run_id""",
)
def run_stats(spark, d):
    return O.run_stats(I.members(spark, d), ["run_id"])


@query(
    "clusters_by_size",
    """SELECT run_id, cluster_id, total_detections, round(avg_confidence, 6) AS avg_confidence FROM clusters""",
)
def clusters_by_size(spark, d):
    slim = I.clusters(spark, d).select("run_id", "cluster_id", "total_detections", "avg_confidence")
    return O.clusters_by_size(slim, "total_detections", "cluster_id")


@query(
    "size_histogram",
    """SELECT count(*) AS n_clusters, count(*) FILTER (s BETWEEN 2 AND 5) AS small_2_5, count(*) FILTER (s BETWEEN 6 AND 15) AS medium_6_15,
 count(*) FILTER (s >= 16) AS large_16_up, count(*) FILTER (s BETWEEN 2 AND 3) AS small_2_3,
 count(*) FILTER (s BETWEEN 4 AND 8) AS medium_4_8, count(*) FILTER (s >= 9) AS large_9_up, max(s) AS largest,
 round(avg(s), 2) AS mean_size FROM (SELECT total_detections AS s FROM clusters)""",
)
def size_histogram(spark, d):
    return O.size_histogram(I.clusters(spark, d), "total_detections")


@query(
    "quality_tiers",
    """SELECT count(*) AS total, count(*) FILTER (cluster_id IS NULL) AS noise_count,
 round(count(*) FILTER (cluster_id IS NULL) / count(*), 3) AS noise_ratio, round(avg(q), 3) AS avg_quality,
 round(avg(confidence), 3) AS avg_confidence, round(avg(blur), 1) AS avg_blur, count(*) FILTER (q > 0.7) AS high_quality,
 count(*) FILTER (q >= 0.4 AND q <= 0.7) AS medium_quality, count(*) FILTER (q < 0.4) AS low_quality
FROM (SELECT *, quality / 10000 AS q FROM members)""",
)
def quality_tiers(spark, d):
    return O.quality_tiers(I.members(spark, d).withColumn("quality", F.col("quality") / 10000))


@query(
    "faces_per_asset",
    """SELECT count(*) AS total_detections, count(DISTINCT asset_id) AS n_assets,
 round(count(*) / count(DISTINCT asset_id), 2) AS avg_per_asset FROM det""",
)
def faces_per_asset(spark, d):
    return O.faces_per_asset(I.detections(spark, d))


define(
    "person_stats",
    """SELECT run_id, person_id, count(*) AS total_vectors, count(*) FILTER (is_owner) AS owner_vectors,
 coalesce(avg(CASE WHEN detection_id % 13 <> 5 THEN confidence END), 0) AS avg_confidence FROM members GROUP BY ALL""",
)


@query(
    "person_vector_stats",
    """SELECT run_id, person_id, total_vectors, owner_vectors, round(avg_confidence, 6) AS avg_confidence FROM person_stats""",
)
def person_vector_stats(spark, d):
    return O.person_vector_stats(text_points(spark, d))


def text_points(spark, d):
    """Points whose confidence is text, unreadable in some rows."""
    text = F.when(F.col("detection_id") % 13 == 5, "None").otherwise(F.col("confidence").cast("string"))
    return I.points(spark, d).withColumn("confidence", text)


@query(
    "cluster_vector_stats",
    """SELECT run_id, count(*) AS total_vectors, count(DISTINCT cluster_id) AS clusters_with_vectors,
 count(*) FILTER (cluster_id IS NULL) AS noise_vectors FROM members GROUP BY run_id""",
)
def cluster_vector_stats(spark, d):
    return O.cluster_vector_stats(I.points(spark, d), noise="unassigned")


@query(
    "cluster_vector_counts",
    "SELECT run_id, cluster_id::VARCHAR AS person_id, count(*) AS n_vectors FROM members WHERE cluster_id IS NOT NULL GROUP BY ALL",
)
def cluster_vector_counts(spark, d):
    return O.cluster_vector_counts(I.points(spark, d), noise="unassigned")


@query(
    "run_overview",
    """SELECT run_id, count(DISTINCT cluster_id) AS total_persons, count(*) AS total_faces,
 count(*) FILTER (cluster_id IS NULL) AS unassigned_faces, count(*) FILTER (is_owner) AS owner_count,
 round(count(cluster_id) / count(*) * 100, 1) AS assignment_rate,
 round(count(*) / count(DISTINCT cluster_id), 1) AS avg_per_person FROM members GROUP BY run_id""",
)
def run_overview(spark, d):
    return O.run_overview(I.points(spark, d))


@query(
    "run_overview_top",
    """SELECT t.run_id, t.n AS rank, t.person_id, t.total_vectors, round(t.avg_confidence, 3) AS avg_confidence,
 m.detection_id AS owner_id, m.asset_id AS owner_asset
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total_vectors DESC, person_id) AS n FROM person_stats
 WHERE person_id <> 'unassigned') t
LEFT JOIN (SELECT * FROM members WHERE is_owner) m USING (run_id, person_id) WHERE t.n <= 10""",
)
def run_overview_top(spark, d):
    return O.run_overview_top(text_points(spark, d))


@query(
    "run_status",
    """SELECT run_id, n AS person_rank, cluster_id, unique_assets, round(avg_confidence, 6) AS avg_confidence, owner_id,
 array_to_string(list_sort((SELECT list(DISTINCT m.asset_id) FROM members m WHERE m.run_id = t.run_id AND m.cluster_id = t.cluster_id))[1:3], ',')
  AS sample_assets,
 (SELECT count(*) FROM assignments a WHERE a.run_id = t.run_id) AS total_assigned
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY unique_assets DESC, cluster_id) AS n FROM clusters) t WHERE n <= 5""",
)
def run_status(spark, d):
    top = O.run_status_top(I.clusters(spark, d), I.members(spark, d))
    counts = I.assignments(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_assigned"))
    samples = F.array_join(F.transform("sample_assets", lambda a: a.cast("string")), ",")
    return top.join(counts, "run_id", "left").select(
        "run_id", "person_rank", "cluster_id", "unique_assets", "avg_confidence", "owner_id",
        samples.alias("sample_assets"), F.coalesce("total_assigned", F.lit(0)).alias("total_assigned"),
    )


@query(
    "run_history",
    """SELECT bucket, sub_bucket, run_id, total_persons, total_images, total_faces, unassigned_faces,
 (SELECT count(*) FROM assignments a WHERE a.run_id = r.run_id) AS assignments_count,
 row_number() OVER (PARTITION BY bucket, sub_bucket ORDER BY ts DESC, run_id) = 1 AS is_latest FROM runs r""",
)
def run_history(spark, d):
    history = O.run_history(I.runs(spark, d), I.assignments(spark, d))
    return history.select(
        "bucket", "sub_bucket", "run_id", "total_persons", "total_images", "total_faces", "unassigned_faces",
        "assignments_count", "is_latest",
    )


@query(
    "latest_run",
    """SELECT bucket, sub_bucket, run_id, total_faces FROM (SELECT *,
 row_number() OVER (PARTITION BY bucket, sub_bucket ORDER BY ts DESC, run_id) AS n FROM runs) WHERE n = 1""",
)
def latest_run(spark, d):
    return O.latest_run(I.runs(spark, d)).select("bucket", "sub_bucket", "run_id", "total_faces")


@query(
    "person_details",
    """SELECT run_id, cluster_id, total_detections AS total_appearances, round(avg_confidence, 6) AS avg_confidence,
 round(best_quality, 6) AS best_quality, owner_id, d.asset_id AS owner_asset FROM clusters JOIN det d ON d.detection_id = owner_id""",
)
def person_details(spark, d):
    return O.person_details(I.members(spark, d))


@query(
    "run_statistics_top10",
    """SELECT run_id, n AS rank, cluster_id, unique_assets, owner_id, total_faces FROM (SELECT *,
 row_number() OVER (PARTITION BY run_id ORDER BY unique_assets DESC, cluster_id) AS n FROM clusters) JOIN runs USING (run_id) WHERE n <= 10""",
)
def run_statistics_top10(spark, d):
    top = O.run_statistics_top(I.clusters(spark, d), 10)
    totals = I.runs(spark, d).select("run_id", "total_faces")
    return top.join(totals, "run_id").select("run_id", "rank", "cluster_id", "unique_assets", "owner_id", "total_faces")


@query(
    "processing_rollup",
    """SELECT user_id, n AS total_files, p AS processed_files, f AS failed_files, round(t, 2) AS total_seconds,
 round(p * 100.0::DOUBLE / n, 1) AS success_rate_percent, round(p / t, 2) AS files_per_second, round(t / n, 3) AS avg_seconds_per_file
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'processed') AS p, count(*) FILTER (status = 'failed') AS f,
 sum(seconds) AS t FROM plog GROUP BY user_id)""",
)
def processing_rollup(spark, d):
    return O.processing_rollup(I.processing_log(spark, d), ["user_id"])


@query(
    "clustering_rollup",
    """SELECT run_id, count(*) AS total_faces, count(cluster_id) AS valid_faces, count(DISTINCT asset_id) AS n_assets,
 count(DISTINCT cluster_id) AS num_clusters, round(count(*) / count(DISTINCT asset_id), 2) AS faces_per_asset,
 round(count(DISTINCT cluster_id) * 100.0::DOUBLE / count(cluster_id), 1) AS clustering_efficiency FROM members GROUP BY run_id""",
)
def clustering_rollup(spark, d):
    return O.clustering_rollup(I.members(spark, d))


@query(
    "cluster_members",
    """SELECT run_id, cluster_id, detection_id, asset_id, round(confidence, 6) AS confidence, round(quality, 6) AS quality, is_owner
FROM members WHERE run_id = 'r1a' AND cluster_id = 0""",
)
def cluster_members(spark, d):
    return O.cluster_members(I.members(spark, d), "r1a", 0)
