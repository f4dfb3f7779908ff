"""Whole flows: cluster a collection, assign its clusters, admit profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.functions.vectors import l2_normalize, norm
from clanmark.operators.assign import assign_clusters, assignment_upsert, load_profiles
from clanmark.operators.components import similarity_components
from clanmark.operators.filters import profile_outcome, quality_topk
from clanmark.operators.maintain import upsert_profile, validate_profile
from clanmark.operators.matching import merge_pairs_greedy
from clanmark.operators.summary import cluster_profile, select_owner
from clanmark.sources.workspace import materialize


def cluster_members(
    detections: DataFrame,
    threshold: float = 0.75,
    merge_threshold: float | None = None,
    per_asset: int | None = None,
    vector: str = "vector",
) -> DataFrame:
    """Detections with ``cluster_id``: components, one merge pass.

    ``merge_threshold`` defaults to ``threshold`` + 0.1; a number ``per_asset`` keeps
    only that many of the best detections of an asset (see ``quality_topk``).
    """
    kept = detections if per_asset is None else quality_topk(detections, "asset_id", "detection_id", per_asset)
    merge = threshold + 0.1 if merge_threshold is None else merge_threshold
    unit = F.when(norm(vector) > 0, l2_normalize(vector))
    rows = materialize(kept.withColumn("unit", unit), "detections")
    parts = similarity_components(rows, "detection_id", "unit", threshold)
    members = materialize(rows.join(parts, "detection_id"), "members")
    merged = merge_pairs_greedy(members, "component", "unit", merge)
    return merged.withColumn("cluster_id", F.col("merged")).drop("merged", "component")


def entities(detections: DataFrame, **options) -> DataFrame:
    """One row per entity: its owner detection and profile, most detections first."""
    members = materialize(cluster_members(detections, **options), "members")
    owners = select_owner(members, ["cluster_id"], ("asset_id",)).withColumnRenamed("asset_id", "owner_asset")
    profile = cluster_profile(members, ["cluster_id"])
    return profile.join(owners, "cluster_id").orderBy(F.desc("total_detections"), "cluster_id")


def link_users(
    clusters: DataFrame,
    profiles: DataFrame,
    current: DataFrame,
    at: Column,
    threshold: float = 0.65,
    overwrite: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """New content of the assignment table for all runs in ``clusters`` at once."""
    keyed = clusters.withColumn("cluster_key", F.concat_ws("/", "run_id", F.col("cluster_id").cast("string")))
    found = assign_clusters(keyed.select("cluster_key", "owner_unit"), load_profiles(profiles), threshold)
    columns = ["cluster_key", "run_id", "cluster_id", "bucket_path", F.col("total_detections").alias("face_count")]
    new = found.join(keyed.select(*columns), "cluster_key").drop("cluster_key")
    return assignment_upsert(current, new, at, overwrite, dry_run)


def admit_profiles(
    submissions: DataFrame, detections: DataFrame, current: DataFrame, at: Column, min_dims: int = 128
) -> tuple[DataFrame, DataFrame]:
    """(profile table, outcome per submission): single face, quality gate, constraints, upsert."""
    outcome = profile_outcome(submissions, detections, "asset_id")
    saved = outcome.where("outcome = 'saved'").select("asset_id", "user_id")
    rows = saved.join(detections, "asset_id").select(
        "user_id",
        F.col("vector").alias("embedding"),
        "confidence",
        (F.col("confidence") * F.col("w") * F.col("h")).alias("quality_score"),
        F.array(*[F.col(c).cast("double") for c in ("x", "y", "w", "h")]).alias("bbox"),
        F.col("asset_id").alias("_order"),
    )
    valid = validate_profile(rows, min_dims).where("is_valid").drop("is_valid", "reasons")
    return upsert_profile(current, valid, at, order="_order"), outcome
