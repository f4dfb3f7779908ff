"""Filters, quality scores and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.functions import quality as Q
from clanmark.operators import filters as O
from clanmark.registry import inputs as I
from clanmark.registry.base import query
from clanmark.registry.sqltext import define

define(
    "corners",
    """SELECT detection_id, asset_id, confidence, image_w, image_h, x * 2 + 0.7::DOUBLE - 9 AS x1, y * 2 + 0.3::DOUBLE - 7 AS y1,
 x * 2 + 0.7::DOUBLE + w AS x2, y * 2 + 0.3::DOUBLE + h AS y2 FROM det""",
)
define(
    "clamped",
    """SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY detection_id) AS n FROM (
 SELECT *, c - x AS w, d - y AS h FROM (SELECT detection_id, asset_id, confidence, greatest(0, trunc(x1)::BIGINT) AS x,
  greatest(0, trunc(y1)::BIGINT) AS y, least(image_w, trunc(x2)::BIGINT) AS c, least(image_h, trunc(y2)::BIGINT) AS d
  FROM corners WHERE confidence >= 0.5)) WHERE w >= 30 AND h >= 30""",
)


@query(
    "clamp_boxes",
    """SELECT detection_id, asset_id, x, y, w, h, count(*) OVER (PARTITION BY asset_id) = 1 AS single
FROM clamped""",
)
def clamp_boxes(spark, d):
    x, y = F.col("x") * 2 + 0.7, F.col("y") * 2 + 0.3
    corners = I.detections(spark, d).select(
        "detection_id", "asset_id", "confidence", "image_w", "image_h",
        (x - 9).alias("x1"), (y - 7).alias("y1"), (x + F.col("w")).alias("x2"), (y + F.col("h")).alias("y2"),
    )
    kept = O.clamp_boxes(corners, "asset_id", "detection_id")
    return kept.select("detection_id", "asset_id", "x", "y", "w", "h", "single")


NULLABLE = "CASE WHEN detection_id % 9 = 0 THEN NULL WHEN detection_id % 9 = 1 THEN 0 ELSE confidence END"


@query(
    "quality_area",
    f"""SELECT detection_id, round(CASE WHEN c <> 0 THEN c * (w * h) END, 6) AS quality
FROM (SELECT detection_id, w, h, {NULLABLE} AS c FROM det)""",
)
def quality_area(spark, d):
    i = F.col("detection_id")
    sure = F.when(i % 9 == 1, F.lit(0.0)).when(i % 9 != 0, F.col("confidence"))
    made = Q.quality_area(sure, F.col("w"), F.col("h"))
    return I.detections(spark, d).select("detection_id", made.alias("quality"))


TOPK = """SELECT detection_id, asset_id, round(quality, 6) AS area_quality, n AS quality_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY quality DESC, detection_id) AS n
 FROM det WHERE w >= 30 AND h >= 30 AND confidence >= 0.5) WHERE n <= {k}"""


@query("quality_topk", TOPK.format(k=5))
def quality_topk(spark, d):
    kept = O.quality_topk(I.detections(spark, d), "asset_id", "detection_id")
    return kept.select("detection_id", "asset_id", "area_quality", "quality_rank")


@query("quality_topk_three", TOPK.format(k=3))
def quality_topk_three(spark, d):
    kept = O.quality_topk(I.detections(spark, d), "asset_id", "detection_id", 3)
    return kept.select("detection_id", "asset_id", "area_quality", "quality_rank")


define(
    "strictly",
    """SELECT *, confidence * 0.4::DOUBLE + blur / 300.0::DOUBLE * 0.3::DOUBLE
  + least((w * h) / (image_w * image_h)::DOUBLE * 100, 1) * 0.3::DOUBLE AS q
FROM det WHERE w >= 30 AND h >= 30 AND confidence >= 0.75 AND blur >= 180
 AND (w * h) / (image_w * image_h)::DOUBLE >= 0.01 AND w / h::DOUBLE >= 0.7 AND w / h::DOUBLE <= 1.4""",
)


@query(
    "quality_strict",
    """SELECT detection_id, asset_id, round(q, 6) AS strict_quality FROM (
 SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY q DESC, detection_id) AS n FROM strictly) WHERE n = 1""",
)
def quality_strict(spark, d):
    kept = O.quality_strict(I.detections(spark, d), "asset_id", "detection_id")
    return kept.select("detection_id", "asset_id", "strict_quality")


@query(
    "quality_composite",
    """SELECT detection_id, round(confidence * 0.5 + least(w * h / 10000.0::DOUBLE, 1) * 0.25
 + least(blur / 300.0::DOUBLE, 1) * 0.25, 6) AS quality FROM det""",
)
def quality_composite(spark, d):
    made = Q.quality_composite(F.col("confidence"), F.col("w"), F.col("h"), F.col("blur"))
    return I.detections(spark, d).select("detection_id", made.alias("quality"))


FAILURES = """concat_ws(',', CASE WHEN h < {size} OR w < {size} THEN 'size' END,
 CASE WHEN confidence < {sure} THEN 'confidence' END, CASE WHEN blur < {blur} THEN 'blur' END)"""
PASSED = "(h >= {size} AND w >= {size} AND confidence >= {sure} AND blur >= {blur})"


def reason(size: int, sure: float, blur: int) -> str:
    return FAILURES.format(size=size, sure=sure, blur=blur)


@query(
    "quality_gate_explained",
    f"""SELECT detection_id, {PASSED.format(size=30, sure=0.5, blur=80)} AS passed, {reason(30, 0.5, 80)} AS reason,
 'size:' || least(w, h) || ':30; confidence:' || format('{{:.3f}}', confidence) || ':0.500; blur:'
 || format('{{:.2f}}', blur::DOUBLE) || ':80.00' AS checks FROM det""",
)
def quality_gate_explained(spark, d):
    made = O.quality_gate_explained(I.detections(spark, d))
    return made.select("detection_id", "passed", "reason", F.array_join("checks", "; ").alias("checks"))


@query(
    "quality_presets",
    """SELECT preset, min_size::BIGINT AS min_size, min_confidence::DOUBLE AS min_confidence, min_blur::DOUBLE AS min_blur,
 count(*) AS n, count(*) FILTER (w >= min_size AND h >= min_size AND confidence >= min_confidence AND blur >= min_blur) AS n_passed
FROM det, (VALUES ('default', 30, 0.4::DOUBLE, 50), ('very_lenient', 20, 0.3::DOUBLE, 30), ('lenient', 30, 0.4::DOUBLE, 50),
 ('normal', 40, 0.5::DOUBLE, 80), ('strict', 60, 0.7::DOUBLE, 120)) p(preset, min_size, min_confidence, min_blur)
GROUP BY ALL""",
)
def quality_presets(spark, d):
    return O.preset_sensitivity(I.detections(spark, d))


@query(
    "validate_vectors",
    """SELECT detection_id FROM det WHERE detection_id % 11 NOT IN (1, 2, 3, 4) AND quality / 10000 >= 0.3""",
)
def validate_vectors(spark, d):
    i, v = F.col("detection_id"), F.col("vector")
    empty = F.array().cast("array<double>")
    spoiled = (
        F.when(i % 11 == 1, empty)
        .when(i % 11 == 2, F.transform(v, lambda x: x * 0.0))
        .when(i % 11 == 3, F.concat(v, F.array(F.lit(float("nan")))))
        .when(i % 11 == 4, F.concat(v, F.array(F.lit(float("-inf")))))
        .otherwise(v)
    )
    rows = I.detections(spark, d).select("detection_id", spoiled.alias("v"), (F.col("quality") / 10000).alias("q"))
    return O.validate_vectors(rows, "v", "q").select("detection_id")


@query(
    "one_per_asset",
    """SELECT run_id, asset_id, detection_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, asset_id
 ORDER BY cluster_id IS NULL, cluster_id, detection_id) AS n FROM members) WHERE n = 1""",
)
def one_per_asset(spark, d):
    place = F.struct("run_id", "asset_id").alias("place")
    members = I.members(spark, d).select(place, "cluster_id", "detection_id")
    return O.one_per_asset(members, "place", "cluster_id", "detection_id").select(
        "place.run_id", "place.asset_id", "detection_id", "cluster_id"
    )


@query(
    "profile_outcome",
    f"""SELECT asset_id, n AS detections, CASE WHEN n = 0 THEN 'no_face' WHEN n > 1 THEN 'multiple'
  WHEN {PASSED.format(size=30, sure=0.4, blur=50)} THEN 'saved' ELSE 'rejected' END AS outcome,
 CASE WHEN n <> 1 THEN '' ELSE {reason(30, 0.4, 50)} END AS reason
FROM (SELECT i AS asset_id, count(detection_id) AS n, min(w) AS w, min(h) AS h, min(confidence) AS confidence, min(blur) AS blur
 FROM e LEFT JOIN (SELECT *, detection_id * detection_id % (SELECT count(*) FROM e) AS sub FROM det) ON sub = i GROUP BY i)""",
)
def profile_outcome(spark, d):
    # one submission per embedding; squares modulo the table size give 0, 1 or several detections
    embeddings = I.embeddings(spark, d)
    i = F.col("detection_id")
    found = I.detections(spark, d).withColumn("asset_id", i * i % F.lit(embeddings.count()))
    submissions = embeddings.select(F.col("vec_id").alias("asset_id"))
    return O.profile_outcome(submissions, found, "asset_id").select("asset_id", "detections", "outcome", "reason")


@query(
    "sanitize_profile",
    """SELECT user_id, round(confidence, 6) AS confidence, quality_score, len(embedding) AS embedding_size,
 len(bbox) > 0 AS has_bbox, round(embedding[1], 6) AS first_value, len(embedding[1:5]) AS n_shown,
 bbox[3] AS bbox_width, bbox[4] AS bbox_height FROM submitted""",
)
def sanitize_profile(spark, d):
    made = O.sanitize_profile(I.submitted_profiles(spark, d))
    return made.withColumns(
        {"first_value": F.get("first_values", F.lit(0)), "n_shown": F.size("first_values")}
    ).drop("first_values")
