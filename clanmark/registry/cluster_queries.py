"""Clustering, merging and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.operators.components import name_components, similarity_components
from clanmark.operators.density import dbscan
from clanmark.operators.linkage import agglomerative_average
from clanmark.operators.matching import merge_pairs_greedy
from clanmark.operators import refine as R
from clanmark.registry import inputs as I
from clanmark.registry.base import query
from clanmark.registry.sqltext import components, define, mean_of
from clanmark.sources.workspace import materialize


@query(
    "connected_components",
    """SELECT id AS detection_id, component, 'person_' || (dense_rank() OVER (ORDER BY component) - 1) AS person_id FROM comp75""",
)
def connected_components(spark, d):
    parts = materialize(similarity_components(I.detections(spark, d), "detection_id", "unit", 0.75), "parts")
    return name_components(parts).select("detection_id", "component", "person_id")


define("lab85", "SELECT d.*, c.component AS label FROM det d JOIN comp85 c ON c.id = d.detection_id")
define("cent85", f"SELECT label, count(*) AS size, {mean_of('unit')} AS c, avg(quality / 10000) AS q FROM lab85 GROUP BY label")
define(
    "cand",
    """SELECT row_number() OVER (ORDER BY a, b) AS n, a, b FROM (SELECT x.label AS a, y.label AS b FROM cent85 x
 JOIN cent85 y ON x.label < y.label WHERE list_cosine_similarity(x.c, y.c) >= 0.75)""",
)
define(
    "scan",
    """SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT c.n, CASE WHEN list_contains(used, c.a) OR list_contains(used, c.b) THEN used ELSE list_concat(used, [c.a, c.b]) END,
 CASE WHEN NOT (list_contains(used, c.a) OR list_contains(used, c.b)) THEN c.a END,
 CASE WHEN NOT (list_contains(used, c.a) OR list_contains(used, c.b)) THEN c.b END
FROM scan s JOIN cand c ON c.n = s.n + 1""",
    "(n, used, a, b)",
    materialized=False,
)


def labels85(spark, d):
    """Components at 0.85 joined to the detections, written once."""
    det = I.detections(spark, d)
    parts = similarity_components(det, "detection_id", "unit", 0.85)
    labelled = det.join(parts, "detection_id").withColumnRenamed("component", "label")
    slim = ["detection_id", "label", "unit", "vector", (F.col("quality") / 10000).alias("q")]
    return materialize(labelled.select(*slim), "labels")


MERGED = "SELECT detection_id, label, coalesce(s.a, label) AS merged FROM lab85 LEFT JOIN scan s ON s.b = label"


@query("merge_pairs_greedy", MERGED)
def merge_pairs(spark, d):
    merged = merge_pairs_greedy(labels85(spark, d), "label", "unit", 0.75)
    return merged.select("detection_id", "label", "merged")


@query("merge_pairs_greedy_rounds", MERGED)
def merge_pairs_rounds(spark, d):
    """The same where components of more than one candidate are too large for one scan, and vectors for one unit."""
    merged = merge_pairs_greedy(labels85(spark, d), "label", "unit", 0.75, scan_edges=1, unit_rows_limit=32)
    return merged.select("detection_id", "label", "merged")


@query(
    "dbscan",
    """SELECT id AS detection_id, CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN component END AS cluster FROM comp75""",
)
def dbscan_default(spark, d):
    return dbscan(I.detections(spark, d), "detection_id", "unit", 0.25, 2)


define(
    "core",
    """SELECT id FROM (SELECT a AS id FROM pair WHERE s >= 0.75 UNION ALL SELECT b FROM pair WHERE s >= 0.75)
 GROUP BY id HAVING count(*) + 1 >= 6""",
)
components(
    "core_comp", "SELECT id FROM core",
    "SELECT a, b FROM pair WHERE s >= 0.75 AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)",
)


@query(
    "dbscan_dense",
    """SELECT d.detection_id, coalesce(c.component, b.component) AS cluster FROM det d LEFT JOIN core_comp c ON c.id = d.detection_id
LEFT JOIN (SELECT i, min(k.component) AS component FROM (SELECT a AS i, b AS j FROM pair WHERE s >= 0.75 UNION ALL
 SELECT b, a FROM pair WHERE s >= 0.75) JOIN core_comp k ON k.id = j GROUP BY i) b ON b.i = d.detection_id""",
)
def dbscan_dense(spark, d):
    return dbscan(I.detections(spark, d), "detection_id", "unit", 0.25, 6)


components("comp60", "SELECT detection_id AS id FROM det", "SELECT a, b FROM pair WHERE s >= 0.6")
components("comp875", "SELECT detection_id AS id FROM det", "SELECT a, b FROM pair WHERE s >= 0.875")


@query(
    "dbscan_variants",
    """SELECT 'cosine' AS metric, id AS detection_id, CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN component END AS cluster
FROM comp60 UNION ALL SELECT 'euclidean', id, CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN component END FROM comp875""",
)
def dbscan_variants(spark, d):
    det = I.detections(spark, d)
    wide = dbscan(det, "detection_id", "unit", 0.4, 2)
    tight = dbscan(det, "detection_id", "unit", 0.5, 2, "euclidean")
    return wide.select(F.lit("cosine").alias("metric"), "*").unionByName(
        tight.select(F.lit("euclidean").alias("metric"), "*")
    )


def average_linkage_sql(name: str, vertices: str, pairs: str, limit: float) -> None:
    """The textbook loop: merge the closest two clusters while their average distance is < limit."""
    define(
        name,
        f"""SELECT 0::BIGINT, id, id FROM ({vertices}) UNION ALL
SELECT s.step + 1, s.id, CASE WHEN s.c = b.hi THEN b.lo ELSE s.c END FROM {name} s, (
 SELECT least(x.c, y.c) AS lo, greatest(x.c, y.c) AS hi FROM ({pairs}) p JOIN {name} x ON x.id = p.a JOIN {name} y ON y.id = p.b
 WHERE x.c <> y.c GROUP BY ALL HAVING 1 - avg(p.s) < {limit} ORDER BY avg(p.s) DESC, lo, hi LIMIT 1) b""",
        "(step, id, c)",
        materialized=False,
    )


average_linkage_sql("hac12", "SELECT detection_id AS id FROM det", "SELECT * FROM pair", 0.12)
average_linkage_sql("hac40", "SELECT detection_id AS id FROM det", "SELECT * FROM pair", 0.4)
define(
    "cent_pair",
    """SELECT x.label AS a, y.label AS b, list_cosine_similarity(x.c, y.c) AS s FROM cent85 x JOIN cent85 y ON x.label < y.label""",
)
average_linkage_sql("hac_forced", "SELECT label AS id FROM cent85", "SELECT * FROM cent_pair", 0.25)
LAST = "SELECT id, c FROM {0} WHERE step = (SELECT max(step) FROM {0})"


@query("agglomerative_average", f"SELECT id AS detection_id, c AS cluster FROM ({LAST.format('hac12')})")
def agglomerative(spark, d):
    return agglomerative_average(I.detections(spark, d), "detection_id", "vector", 0.12)


@query("agglomerative_average_wide", f"SELECT id AS detection_id, c AS cluster FROM ({LAST.format('hac40')})")
def agglomerative_wide(spark, d):
    return agglomerative_average(I.detections(spark, d), "detection_id", "vector", 0.4)


define("dens85", "SELECT *, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label END AS dense FROM lab85")
define(
    "small_move",
    """SELECT old, new FROM (SELECT x.label AS old, y.label AS new, list_cosine_similarity(x.c, y.c) AS s,
  row_number() OVER (PARTITION BY x.label ORDER BY list_cosine_similarity(x.c, y.c) DESC, y.label) AS n
 FROM cent85 x JOIN cent85 y ON x.size > 1 AND x.size < 3 AND y.size >= 3) WHERE n = 1 AND s > 0.72""",
)


@query(
    "absorb_small",
    "SELECT detection_id, coalesce(new, dense) AS label FROM dens85 LEFT JOIN small_move ON old = dense",
)
def absorb_small(spark, d):
    noise_free = dbscan(I.detections(spark, d), "detection_id", "unit", 0.15, 2)
    members = I.detections(spark, d).select("detection_id", "unit").join(noise_free, "detection_id")
    members = materialize(members.withColumnRenamed("cluster", "label"), "labels")
    return R.absorb_small(members, "detection_id", "label", "unit")


@query(
    "absorb_small_quality",
    """SELECT detection_id, coalesce(new, label) AS label FROM lab85 LEFT JOIN (
 SELECT old, new FROM (SELECT x.label AS old, y.label AS new, list_inner_product(x.c, y.c) + least(y.q * 0.1, 0.05) AS s,
  row_number() OVER (PARTITION BY x.label ORDER BY list_inner_product(x.c, y.c) + least(y.q * 0.1, 0.05) DESC, y.label) AS n
 FROM cent85 x JOIN cent85 y ON x.size < 2 AND y.size >= 2) WHERE n = 1 AND s > 0.7) ON old = label""",
)
def absorb_small_quality(spark, d):
    return R.absorb_small_quality(labels85(spark, d), "detection_id", "label", "unit", "q")


@query(
    "absorb_singletons",
    """SELECT detection_id, coalesce(new, label) AS label FROM lab85 LEFT JOIN (
 SELECT old, new FROM (SELECT x.label AS old, y.label AS new, list_cosine_similarity(x.c, y.c) AS s,
  row_number() OVER (PARTITION BY x.label ORDER BY list_cosine_similarity(x.c, y.c) DESC, y.label) AS n
 FROM cent85 x JOIN cent85 y ON x.size < 2 AND y.size >= 2) WHERE n = 1 AND s > 0.7) ON old = label""",
)
def absorb_singletons(spark, d):
    return R.absorb_singletons(labels85(spark, d), "detection_id", "label", "unit")


components(
    "cent_comp", "SELECT label AS id FROM cent85",
    "SELECT x.label AS a, y.label AS b FROM cent85 x JOIN cent85 y ON x.label < y.label WHERE list_cosine_similarity(x.c, y.c) >= 0.75",
)


@query(
    "merge_components",
    "SELECT detection_id, c.component AS label FROM lab85 JOIN cent_comp c ON c.id = label",
)
def merge_components(spark, d):
    return R.merge_components(labels85(spark, d), "detection_id", "label", "unit", 0.75)


@query("force_merge", f"SELECT detection_id, c AS label FROM lab85 JOIN ({LAST.format('hac_forced')}) ON id = label")
def force_merge(spark, d):
    return R.force_merge(labels85(spark, d), "detection_id", "label", "unit", 0.25)


define("cent75raw", f"SELECT component AS label, count(*) AS size, {mean_of('vector')} AS c FROM det JOIN comp75 ON id = detection_id GROUP BY component")
define(
    "spread75",
    """SELECT detection_id, component AS label, quality / 10000 AS q, 1 - list_inner_product(vector, c) AS dist, size
FROM det JOIN comp75 ON id = detection_id JOIN cent75raw ON label = component""",
)


@query(
    "outliers_to_noise",
    """SELECT detection_id, CASE WHEN size >= 2 AND dist > m + 1.2 * sd AND q < 0.6 THEN NULL ELSE label END AS label
FROM (SELECT *, avg(dist) OVER (PARTITION BY label) AS m, stddev_pop(dist) OVER (PARTITION BY label) AS sd FROM spread75)""",
)
def outliers_to_noise(spark, d):
    det = I.detections(spark, d)
    parts = similarity_components(det, "detection_id", "unit", 0.75)
    members = det.select("detection_id", "vector", (F.col("quality") / 10000).alias("q")).join(parts, "detection_id")
    members = materialize(members.withColumnRenamed("component", "label"), "labels")
    # groups of at most 20 planted rows rarely exceed two deviations
    return R.outliers_to_noise(members, "detection_id", "label", "vector", "q", deviations=1.2)


@query(
    "label_split",
    """SELECT 'cluster_' || (row_number() OVER (ORDER BY count(*) DESC, min(detection_id)) - 1) AS cluster_id, count(*) AS size,
 min(detection_id) AS first_id FROM dens85 WHERE dense IS NOT NULL GROUP BY dense
UNION ALL SELECT 'noise', 1, detection_id FROM dens85 WHERE dense IS NULL""",
)
def label_split(spark, d):
    labels = dbscan(I.detections(spark, d), "detection_id", "unit", 0.15, 2)
    clusters, noise = R.label_split(materialize(labels, "labels"), "detection_id", "cluster")
    left = clusters.select("cluster_id", "size", "first_id")
    right = noise.select(
        F.lit("noise").alias("cluster_id"), F.lit(1).cast("long").alias("size"), F.col("detection_id").alias("first_id")
    )
    return left.unionByName(right)
