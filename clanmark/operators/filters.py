"""Projections, filters and validation of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clanmark.functions import quality as Q
from clanmark.functions.vectors import dimension_of, is_finite, norm
from clanmark.operators.numbering import first_per


def clamp_boxes(
    boxes: DataFrame, asset: str, order: str, min_size: int = 30, min_confidence: float = 0.5,
    keep: int | None = None,
) -> DataFrame:
    """Corner boxes (x1, y1, x2, y2) to (x, y, w, h) inside the image.

    Coordinates are truncated to integers and clamped, boxes under the minimum size or
    confidence dropped; a number ``keep`` keeps the first ones of an asset in detector
    ``order``.  ``single`` is true where the asset kept exactly one.
    """
    x1 = F.greatest(F.lit(0), F.col("x1").cast("int"))
    y1 = F.greatest(F.lit(0), F.col("y1").cast("int"))
    x2 = F.least(F.col("image_w").cast("int"), F.col("x2").cast("int"))
    y2 = F.least(F.col("image_h").cast("int"), F.col("y2").cast("int"))
    clamped = boxes.where(F.col("confidence") >= min_confidence).withColumns(
        {"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}
    )
    clamped = clamped.where((F.col("w") >= min_size) & (F.col("h") >= min_size))
    kept = clamped if keep is None else first_per(clamped, [asset], [F.asc(order)], keep)
    counts = kept.groupBy(F.col(asset).alias("_asset")).agg((F.count(F.lit(1)) == 1).alias("single"))
    joined = kept.join(counts, kept[asset].eqNullSafe(counts["_asset"]))
    return joined.drop("_asset", "x1", "y1", "x2", "y2")


def quality_topk(
    detections: DataFrame, asset: str, key: str, k: int = 5, min_size: int = 30, min_confidence: float = 0.5
) -> DataFrame:
    """Detections of enough size and confidence; the ``k`` best per asset by area quality."""
    enough = (F.col("w") >= min_size) & (F.col("h") >= min_size) & (F.col("confidence") >= min_confidence)
    area = F.col("confidence") * (F.col("w") * F.col("h"))
    scored = detections.where(enough).withColumn("area_quality", area)
    return first_per(scored, [asset], [F.desc("area_quality"), F.asc(key)], k, "quality_rank")


def quality_strict(
    detections: DataFrame,
    asset: str,
    key: str,
    k: int = 1,
    min_size: int = 30,
    min_confidence: float = 0.75,
    min_blur: float = 180.0,
) -> DataFrame:
    """Strict gate on size, confidence, blur, area ratio and aspect; ``k`` best per asset."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    ratio = (w * h) / (F.col("image_w") * F.col("image_h"))
    aspect = F.when(h > 0, w / h).otherwise(0.0)
    passing = detections.where(
        (w >= min_size) & (h >= min_size)
        & (F.col("confidence") >= min_confidence) & (F.col("blur") >= min_blur)
    ).withColumn("area_ratio", ratio)
    passing = passing.where((F.col("area_ratio") >= 0.01) & (aspect >= 0.7) & (aspect <= 1.4))
    score = Q.quality_strict_score(F.col("confidence"), F.col("blur").cast("double"), F.col("area_ratio"))
    return first_per(
        passing.withColumn("strict_quality", score), [asset], [F.desc("strict_quality"), F.asc(key)], k
    )


def quality_gate_explained(
    detections: DataFrame, min_size: int = 30, min_confidence: float = 0.5, min_blur: float = 80.0
) -> DataFrame:
    """Adds ``passed``, ``checks`` (each with its value and limit) and ``reason`` (the failed ones)."""
    passed, checks, reason = Q.gate(
        F.col("w"), F.col("h"), F.col("confidence"), F.col("blur"),
        F.lit(min_size), F.lit(min_confidence), F.lit(min_blur),
    )
    return detections.withColumns({"passed": passed, "checks": checks, "reason": reason})


def preset_sensitivity(detections: DataFrame) -> DataFrame:
    """How many detections every named parameter row lets through."""
    slim = detections.select("w", "h", "confidence", "blur", F.explode(Q.preset_array()).alias("p"))
    passed, _, _ = Q.gate(
        F.col("w"), F.col("h"), F.col("confidence"), F.col("blur"),
        F.col("p.min_size"), F.col("p.min_confidence"), F.col("p.min_blur"),
    )
    return slim.groupBy(F.col("p.preset").alias("preset"), F.col("p.min_size").alias("min_size"),
                        F.col("p.min_confidence").alias("min_confidence"), F.col("p.min_blur").alias("min_blur")
                        ).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("n_passed"))


def validate_vectors(
    detections: DataFrame, vector: str, quality: str, min_norm: float = 0.1, min_quality: float = 0.3
) -> DataFrame:
    """Non-empty, finite vectors of some length with enough quality (missing counts as 0)."""
    good = (F.size(vector) > 0) & is_finite(vector)
    return detections.where(
        good & (norm(vector) >= min_norm) & (F.coalesce(F.col(quality), F.lit(0.0)) >= min_quality)
    )


def one_per_asset(members: DataFrame, asset: str, cluster: str, key: str) -> DataFrame:
    """Asset → its representative: first member of the first cluster that contains it.

    Members without a cluster come last, so they represent assets that no cluster holds.
    """
    order = F.struct(F.col(cluster).isNull().alias("loose"), F.col(cluster).alias("c"), F.col(key).alias("k"))
    return members.groupBy(asset).agg(F.min(order).alias("m")).select(
        asset, F.col("m.k").alias(key), F.col("m.c").alias(cluster)
    )


def profile_outcome(
    submissions: DataFrame,
    detections: DataFrame,
    asset: str,
    min_size: int = 30,
    min_confidence: float = 0.4,
    min_blur: float = 50.0,
) -> DataFrame:
    """Per submitted asset: no_face, multiple, rejected with the failed checks, or saved."""
    slim = ["w", "h", "confidence", "blur"]
    found = detections.groupBy(asset).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in slim]
    )  # the values are only used where there is exactly one row
    joined = submissions.join(found, asset, "left").withColumn("detections", F.coalesce("_n", F.lit(0)))
    passed, _, reason = Q.gate(
        F.col("w"), F.col("h"), F.col("confidence"), F.col("blur"),
        F.lit(min_size), F.lit(min_confidence), F.lit(min_blur),
    )
    none, many = F.col("detections") == 0, F.col("detections") > 1
    outcome = F.when(none, "no_face").when(many, "multiple").when(passed, "saved").otherwise("rejected")
    why = F.when(~none & ~many, reason).otherwise(F.lit(""))
    return joined.withColumns({"outcome": outcome, "reason": why}).drop("_n", *slim)


def sanitize_profile(profiles: DataFrame) -> DataFrame:
    """Profiles without the vector: its size, first values and a box summary instead."""
    box = F.col("bbox")
    return profiles.select(
        "user_id", "confidence", "quality_score",
        F.coalesce(F.size("embedding"), F.lit(0)).alias("embedding_size"),
        F.coalesce(F.size(box) > 0, F.lit(False)).alias("has_bbox"),
        F.slice("embedding", 1, 5).alias("first_values"),
        F.get(box, F.lit(2)).alias("bbox_width"),
        F.get(box, F.lit(3)).alias("bbox_height"),
    )


def left_out(df: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """(reason, rows): how many rows a vector operator can use, and why it leaves the others out.

    Reasons in the order of their checks: null, empty, other_length (than ``dim``, by default the usual
    length of the table), not_finite (a null element too), zero; the rest is usable.  A reason without rows
    has no row.
    """
    dim = dimension_of(df, vector) if dim is None else dim
    v = F.col(vector)
    reason = (
        F.when(v.isNull(), "null")
        .when(F.size(v) == 0, "empty")
        .when(F.size(v) != dim, "other_length")
        .when(~is_finite(v), "not_finite")
        .when(norm(v) == 0, "zero")
        .otherwise("usable")
    )
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
