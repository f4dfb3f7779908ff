"""Similarity joins and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.operators import assign as A
from clanmark.operators import similarity as O
from clanmark.operators.components import similarity_components
from clanmark.operators.summary import latest_run
from clanmark.registry import inputs as I
from clanmark.registry.base import query
from clanmark.registry.sqltext import define
from clanmark.sources.workspace import materialize


@query("similarity_self_join", "SELECT a, b, round(s, 6) AS similarity FROM pair WHERE s >= 0.75")
def similarity_self_join(spark, d):
    return O.similarity_self_join(I.detections(spark, d), "detection_id", "vector", 0.75)


define(
    "cross_pair",
    """SELECT d.detection_id, p.user_id, list_cosine_similarity(d.unit, p.embedding) AS s FROM det d, profiles p""",
)


@query(
    "similarity_cross_join",
    "SELECT detection_id, user_id, round(s, 6) AS similarity FROM cross_pair WHERE s >= 0.6",
)
def similarity_cross_join(spark, d):
    pairs = O.similarity_cross_join(
        I.detections(spark, d), I.profiles(spark, d), "detection_id", "unit", "user_id", "embedding", 0.6
    )
    return pairs.withColumnsRenamed({"a": "detection_id", "b": "user_id"})


@query(
    "knn_search",
    """SELECT query, neighbour, round(s, 6) AS similarity, n AS rank, asset_id, round(confidence, 6) AS confidence FROM (
 SELECT user_id AS query, detection_id AS neighbour, s, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 12) DESC, detection_id) AS n
 FROM cross_pair) JOIN det ON detection_id = neighbour WHERE n <= 10""",
)
def knn_search(spark, d):
    det = I.detections(spark, d)
    found = O.knn_search(I.profiles(spark, d), det, "user_id", "embedding", "detection_id", "unit", 10)
    payload = det.select(F.col("detection_id").alias("neighbour"), "asset_id", "confidence")
    return found.join(payload, "neighbour")


@query(
    "argmax_match",
    """SELECT run_id, cluster_id, user_id, round(s, 6) AS similarity FROM (SELECT *,
 row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY round(s, 12) DESC, user_id) AS n FROM scores) WHERE n = 1""",
)
def argmax_match(spark, d):
    clusters = I.clusters(spark, d)
    best = O.argmax_match(clusters, I.profiles(spark, d), "cluster_key", "owner_unit", "user_id", "embedding")
    named = clusters.select(F.col("cluster_key").alias("a"), "run_id", "cluster_id")
    return best.join(named, "a").select("run_id", "cluster_id", F.col("b").alias("user_id"), "similarity")


@query(
    "threshold_match",
    "SELECT user_id, detection_id, round(s, 6) AS similarity FROM cross_pair WHERE s > 0.7",
)
def threshold_match(spark, d):
    known = A.load_profiles(I.profiles(spark, d))
    return A.threshold_match(known, I.detections(spark, d), "detection_id", "unit", 0.7)


define(
    "newest",
    """SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY bucket, sub_bucket ORDER BY ts DESC, run_id) AS n
 FROM runs) WHERE n = 1""",
)
define(
    "found_in",
    """SELECT user_id, run_id, cluster_id, max(s) AS best, count(*) AS m FROM members
 JOIN newest USING (run_id) JOIN cross_pair USING (detection_id) WHERE s > 0.7 AND cluster_id IS NOT NULL GROUP BY ALL""",
)


@query(
    "search_profile_all_clusters",
    """SELECT user_id, run_id, cluster_id, round(best, 6) AS best_similarity, m AS matches_count, total_detections AS cluster_size,
 row_number() OVER (PARTITION BY user_id ORDER BY round(best, 12) DESC, run_id, cluster_id) AS rank,
 (sum(m) OVER (PARTITION BY user_id))::BIGINT AS total_matches, count(*) OVER (PARTITION BY user_id) AS matching_clusters
FROM found_in JOIN clusters USING (run_id, cluster_id)""",
)
def search_profile_all_clusters(spark, d, **layout):
    newest = latest_run(I.runs(spark, d)).select("run_id")
    members = I.members(spark, d).where(F.col("cluster_id").isNotNull()).join(newest, "run_id", "left_semi")
    members = members.select(F.struct("run_id", "cluster_id").alias("place"), "detection_id", "unit")
    known = A.load_profiles(I.profiles(spark, d))
    found = A.identify_in_clusters(known, members, "place", "detection_id", "unit", 0.7, **layout)
    ranked = A.search_profile_all_clusters(found, "place")
    return ranked.select("user_id", "place.*", "best_similarity", "matches_count", "cluster_size", "rank",
                         "total_matches", "matching_clusters")


define(
    "asked",
    """SELECT detection_id, 'user_' || lpad((detection_id // 20)::VARCHAR, 6, '0') AS user_id, detection_id // 20 AS k,
 CASE WHEN detection_id % 6 = 5 THEN component + 1000000 ELSE component END AS cluster_id FROM det JOIN comp75 ON id = detection_id""",
)


@query(
    "identification_outcome",
    """SELECT detection_id, a.user_id, a.cluster_id, CASE WHEN z.n IS NULL THEN 'empty_cluster' WHEN k % 5 = 1 THEN 'invalid_profile'
 WHEN m.n > 0 THEN 'match' ELSE 'no_match' END AS outcome, coalesce(z.n, 0) AS total_in_cluster,
 CASE WHEN k % 5 = 1 THEN 0 ELSE coalesce(m.n, 0) END AS matches_count
FROM asked a LEFT JOIN (SELECT component, count(*) AS n FROM comp75 GROUP BY component) z ON z.component = a.cluster_id
LEFT JOIN (SELECT component, user_id, count(*) AS n FROM comp75 JOIN cross_pair ON detection_id = id WHERE s > 0.7 GROUP BY ALL) m
 ON m.component = a.cluster_id AND m.user_id = a.user_id""",
)
def identification_outcome(spark, d):
    """One request per detection; every sixth names an unknown cluster, every fifth profile is zero."""
    det = I.detections(spark, d)
    parts = similarity_components(det, "detection_id", "unit", 0.75)
    members = det.select("detection_id", "unit").join(parts, "detection_id")
    members = materialize(members.withColumnRenamed("component", "cluster_id"), "members")
    k = F.substring("user_id", 6, 6).cast("long")
    zero = F.transform("embedding", lambda x: x * 0.0)
    spoiled = F.when(k % 5 == 1, zero).otherwise(F.col("embedding"))
    known = A.load_profiles(I.profiles(spark, d).withColumn("embedding", spoiled))
    i = F.col("detection_id")
    moved = F.col("cluster_id") + F.when(i % 6 == 5, 1000000).otherwise(0)
    requests = members.select(
        "detection_id", F.format_string("user_%06d", F.expr("detection_id div 20")).alias("user_id"), moved.alias("cluster_id")
    )
    found = A.identify_in_clusters(known, members, "cluster_id", "detection_id", "unit", 0.7)
    return A.identification_outcome(requests, known, members, found, "cluster_id")


@query(
    "filter_points",
    """SELECT 'run' AS filter, run_id, detection_id FROM members WHERE run_id = 'r1a'
UNION ALL SELECT 'run_person', run_id, detection_id FROM members WHERE run_id = 'r2a' AND person_id = 'unassigned'
UNION ALL SELECT 'owner', run_id, detection_id FROM members WHERE run_id = 'r1b' AND is_owner
UNION ALL SELECT 'ids', run_id, detection_id FROM members WHERE detection_id IN (SELECT owner_id FROM clusters WHERE run_id = 'r2b')""",
)
def filter_points(spark, d):
    points = I.points(spark, d)
    ids = I.clusters(spark, d).where("run_id = 'r2b'").select(F.col("owner_id").alias("detection_id"))
    parts = [
        ("run", A.filter_points(points, run_id="r1a")),
        ("run_person", A.filter_points(points, run_id="r2a", person_id="unassigned")),
        ("owner", A.filter_points(points, run_id="r1b", owner=True)),
        ("ids", A.filter_points(points, ids=ids)),
    ]
    whole = None
    for name, part in parts:
        slim = part.select(F.lit(name).alias("filter"), "run_id", "detection_id")
        whole = slim if whole is None else whole.unionByName(slim)
    return whole


@query("distinct_face_ids", "SELECT DISTINCT detection_id FROM members")
def distinct_face_ids(spark, d):
    return A.distinct_face_ids(I.points(spark, d))
