"""Keyed upserts, updates and deletes: each returns the new content of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.functions.paths import valid_user_id


def validate_profile(profiles: DataFrame, min_dims: int = 128, max_dims: int = 1024) -> DataFrame:
    """Adds ``reasons`` (failed constraints, in a fixed order) and ``is_valid``."""
    uid, vec, box = F.col("user_id"), F.col("embedding"), F.col("bbox")
    length = F.coalesce(F.length(uid), F.lit(0))
    dims = F.coalesce(F.size(vec), F.lit(0))

    def reason(failed: Column, text: str) -> Column:
        return F.when(F.coalesce(failed, F.lit(False)), F.lit(text))

    reasons = F.array_compact(
        F.array(
            reason(~valid_user_id(uid), "user_id_characters"),
            reason((length < 3) | (length > 64), "user_id_length"),
            reason((dims < min_dims) | (dims > max_dims), "embedding_dimensions"),
            reason((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_range"),
            reason(F.col("quality_score") < 0, "quality_range"),
            reason(F.size(box) != 4, "bbox_length"),
        )
    )
    return profiles.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def upsert_profile(
    current: DataFrame, new: DataFrame, at: Column, order: str, key: str = "user_id"
) -> DataFrame:
    """Merge ``new`` into ``current`` by key; NULL fields do not overwrite.

    Several new rows of one key count as upserts in ``order``: each field takes its last value
    that is not NULL (the larger one of two at the same place).  ``created_at`` of a
    known key is kept, ``updated_at`` is set on every touched row.
    """
    fields = [c for c in current.columns if c not in (key, "created_at", "updated_at")]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("_o"), c))).alias(f"_m_{c}") for c in fields]
    new = new.groupBy(key).agg(*last).select(key, *[F.col(f"_m_{c}.{c}").alias(c) for c in fields])
    patch = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = current.join(patch, F.col(key) == F.col("_k"), "full")
    touched = F.col("_k").isNotNull()
    merged = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    return joined.select(
        F.coalesce(key, "_k").alias(key),
        *[merged[c].alias(c) for c in fields],
        F.coalesce("created_at", at).alias("created_at"),
        F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*current.columns)


def get_profile(profiles: DataFrame, user_id: str) -> DataFrame:
    return profiles.where(F.col("user_id") == user_id)


def list_profiles(profiles: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = profiles.orderBy("user_id")
    return ordered if limit is None else ordered.limit(limit)


def without_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Delete by key table."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def delete_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, one row with the number deleted); NULL conditions delete nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.agg(F.count_if(hit).alias("deleted"))


def reassign_members(
    members: DataFrame, patch: DataFrame, run_id: str, person: Column | str, key: str = "detection_id"
) -> DataFrame:
    """Move the listed detections of one run to ``person``; their owner flag is reset."""
    target = F.lit(person) if isinstance(person, str) else person
    listed = patch.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = members.join(listed, key, "left")
    hit = F.coalesce(F.col("_hit") & (F.col("run_id") == run_id), F.lit(False))
    return joined.withColumns(
        {
            "person_id": F.when(hit, target).otherwise(F.col("person_id")),
            "is_owner": F.when(hit, F.lit(False)).otherwise(F.col("is_owner")),
        }
    ).select(*members.columns)


def relabel_members(members: DataFrame, patch: DataFrame, key: str = "detection_id", label: str = "person_id") -> DataFrame:
    """Pairwise relabelling: ``patch`` holds (key, label), one row per key."""
    renamed = patch.select(key, F.col(label).alias("_new"))
    joined = members.join(renamed, key, "left")
    return joined.withColumn(label, F.coalesce("_new", label)).select(*members.columns)


def stamp_run_id(members: DataFrame, ids: DataFrame, run_id: str, key: str = "detection_id") -> DataFrame:
    listed = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = members.join(listed, key, "left")
    stamped = F.when(F.col("_hit"), F.lit(run_id)).otherwise(F.col("run_id"))
    return joined.withColumn("run_id", stamped).select(*members.columns)


def cleanup_run(
    assignments: DataFrame, points: DataFrame, run_id: str, dry_run: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments left, points left, report); the run row itself is kept."""
    of_run = F.col("run_id") == run_id

    def step(table: DataFrame, name: str) -> DataFrame:
        counted = table.agg(F.count_if(F.coalesce(of_run, F.lit(False))).alias("found"))
        deleted = F.lit(0).cast("long") if dry_run else F.col("found")
        return counted.select(
            F.lit(name).alias("step"), "found", deleted.alias("deleted"), F.lit(True).alias("success")
        )

    report = step(assignments, "assignments").unionByName(step(points, "vectors"))
    if dry_run:
        return assignments, points, report
    return delete_where(assignments, of_run)[0], delete_where(points, of_run)[0], report

