"""Assignment of clusters to known profiles, and what is reported from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.functions.vectors import is_finite, l2_normalize, norm, unit_centroids
from clanmark.operators.numbering import first_per, rank_within
from clanmark.operators.products import similarity_groups
from clanmark.operators.similarity import argmax_match, similarity_cross_join

STRATEGIES = ("centroid", "vote")


def load_profiles(profiles: DataFrame, vector: str = "embedding") -> DataFrame:
    """Profiles with a usable vector, unit length as ``unit``.

    A zero vector stays as it is; it has no direction, so it never matches.
    """
    usable = profiles.where((F.size(vector) > 0) & is_finite(vector))
    return usable.withColumn("unit", l2_normalize(F.col(vector).cast("array<double>")))


def require_profiles(profiles: DataFrame) -> DataFrame:
    if profiles.isEmpty():
        raise ValueError("no profiles with vectors")
    return profiles


def assign_clusters(
    owners: DataFrame,
    profiles: DataFrame,
    threshold: float = 0.65,
    strategy: str = "centroid",
    key: str = "cluster_key",
    vector: str = "owner_unit",
    **options,
) -> DataFrame:
    """(key, user_id, similarity, strategy) for clusters whose best profile is >= ``threshold``.

    Both strategies compare the owner vector, as the original does; the name is only
    recorded.  ``assign_by_centroid`` and ``assign_by_vote`` do what the names say.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    best = argmax_match(owners, profiles, key, vector, "user_id", "unit", threshold, **options)
    return best.select(
        F.col("a").alias(key), F.col("b").alias("user_id"), "similarity", F.lit(strategy).alias("strategy")
    )


def assign_by_centroid(
    members: DataFrame, profiles: DataFrame, key: str, vector: str, threshold: float = 0.65, **options
) -> DataFrame:
    """Best profile of every cluster's unit centroid."""
    centroids = unit_centroids(members, [key], vector)
    return assign_clusters(centroids, profiles, threshold, "centroid", key, "centroid", **options)


def assign_by_vote(
    members: DataFrame, profiles: DataFrame, key: str, member: str, vector: str, threshold: float = 0.65, **options
) -> DataFrame:
    """Every member votes for its best profile; most votes win, then the mean similarity."""
    votes = argmax_match(members, profiles, member, vector, "user_id", "unit", threshold, **options)
    counted = members.select(key, member).join(votes, F.col(member) == F.col("a"))
    counted = counted.groupBy(key, F.col("b").alias("user_id")).agg(
        F.count(F.lit(1)).alias("votes"), F.avg("similarity").alias("similarity")
    )
    rank = F.struct((-F.col("votes")).alias("v"), (-F.col("similarity")).alias("s"), "user_id")
    best = counted.groupBy(key).agg(F.min(rank).alias("m"))
    return best.select(
        key, F.col("m.user_id").alias("user_id"), (-F.col("m.v")).alias("votes"),
        (-F.col("m.s")).alias("similarity"), F.lit("vote").alias("strategy"),
    )


def positional_cluster_ids(clusters: DataFrame, order: list[Column], name: str = "cluster_id") -> DataFrame:
    """``cluster_0``, ``cluster_1``, … of every run, for clusters that carry no id of their own."""
    ranked = rank_within(clusters, ["run_id"], order, "_n")
    return ranked.withColumn(name, F.concat(F.lit("cluster_"), (F.col("_n") - 1).cast("string"))).drop("_n")


def resolve_face_count(
    size: Column, other_counts: list[Column], image_paths: Column, face_ids: Column
) -> Column:
    """``size``, else the first other count, else the longer array; the longer array also
    wins whenever the arrays do not both have that length."""
    n_paths = F.coalesce(F.size(image_paths), F.lit(0))
    n_faces = F.coalesce(F.size(face_ids), F.lit(0))
    longest = F.greatest(n_paths, n_faces)
    stated = F.coalesce(size, *other_counts, longest)
    agrees = (n_paths == stated) & (n_faces == stated)
    return F.when(agrees, stated).otherwise(longest).cast("long")


def align_arrays(image_paths: Column, face_ids: Column) -> tuple[Column, Column]:
    """Pad the shorter array: ``""`` for paths, ``unknown_face_<position>`` for ids."""
    empty = F.array().cast("array<string>")
    paths = F.filter(F.coalesce(image_paths, empty), lambda x: x.isNotNull())
    faces = F.filter(F.coalesce(face_ids, empty), lambda x: x.isNotNull())
    n_paths, n_faces = F.size(paths), F.size(faces)
    missing_paths = F.array_repeat(F.lit(""), F.greatest(n_faces - n_paths, F.lit(0)))
    steps = F.when(n_faces < n_paths, F.sequence(n_faces, n_paths - 1)).otherwise(F.array().cast("array<int>"))
    missing_faces = F.transform(steps, lambda i: F.concat(F.lit("unknown_face_"), i.cast("string")))
    return F.concat(paths, missing_paths), F.concat(faces, missing_faces)


def assignment_totals(clusters: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per run: clusters, assigned and unassigned, in one join over all runs."""
    done = assignments.select("run_id", "cluster_id", F.lit(1).alias("_a"))
    return clusters.join(done, ["run_id", "cluster_id"], "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.count("_a").alias("assigned_clusters"),
        F.count_if(F.col("_a").isNull()).alias("unassigned_clusters"),
    )


def assignment_upsert(
    current: DataFrame,
    new: DataFrame,
    at: Column,
    overwrite: bool = False,
    dry_run: bool = False,
    order: list[Column] | None = None,
) -> DataFrame:
    """``current`` with ``new`` merged in by (run_id, cluster_id).

    Of several new rows with one key the first by ``order`` counts, by default that of the
    highest similarity, then of the lowest user id.
    Replaced rows keep ``created_at``; all new rows get ``updated_at``.  ``overwrite``
    first drops every row of the runs in ``new``; ``dry_run`` changes nothing.
    """
    if dry_run:
        return current
    keys = ["run_id", "cluster_id"]
    fields = [c for c in current.columns if c not in ("created_at", "updated_at")]
    usual = [F.desc("similarity"), F.asc("user_id")] if "similarity" in new.columns else [F.asc("user_id")]
    new = first_per(new, keys, order or usual)
    stamped = new.select(*fields)
    if overwrite:
        kept = current.join(new.select("run_id").distinct(), "run_id", "left_anti")
        created = at
    else:
        kept = current.join(new.select(*keys), keys, "left_anti")
        before = current.select(*keys, F.col("created_at").alias("_created"))
        stamped = stamped.join(before, keys, "left")
        created = F.coalesce("_created", at)
    fresh = stamped.withColumns({"created_at": created, "updated_at": at})
    return kept.select(*current.columns).unionByName(fresh.select(*current.columns))


def album_split(
    owners: DataFrame,
    profiles: DataFrame,
    noise: DataFrame,
    key: str,
    vector: str,
    threshold: float = 0.6,
    noise_threshold: float = 0.5,
    **options,
) -> DataFrame:
    """(kind, id, user_id, similarity): matched and anonymous clusters, matched and plain noise."""

    def judged(rows: DataFrame, limit: float, hit: str, miss: str) -> DataFrame:
        best = argmax_match(rows, profiles, key, vector, "user_id", "unit", **options)
        joined = rows.select(key).join(best, F.col(key) == F.col("a"), "left")
        ok = F.coalesce(F.col("similarity") >= limit, F.lit(False))
        return joined.select(
            F.when(ok, hit).otherwise(miss).alias("kind"), key,
            F.when(ok, F.col("b")).alias("user_id"), "similarity",
        )

    clusters = judged(owners, threshold, "matched", "anonymous")
    return clusters.unionByName(judged(noise, noise_threshold, "matched_noise", "noise"))


def assignments_by_run(assignments: DataFrame, run_id: str) -> DataFrame:
    return assignments.where(F.col("run_id") == run_id)


def assignments_by_user(assignments: DataFrame, user_id: str) -> DataFrame:
    """Newest first."""
    kept = assignments.where(F.col("user_id") == user_id)
    return kept.orderBy(F.desc("created_at"), "run_id", "cluster_id")


def assignments_by_cluster(assignments: DataFrame, run_id: str, cluster_id: int) -> DataFrame:
    return assignments.where((F.col("run_id") == run_id) & (F.col("cluster_id") == cluster_id))


def user_summary(assignments: DataFrame) -> DataFrame:
    """Per user and bucket: clusters and faces, with the user's totals and mean similarity.

    The breakdown is rows and not a map, because a user may appear in any number of buckets.
    """
    per_bucket = assignments.groupBy("user_id", "bucket_path").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("face_count").alias("faces"),
        F.sum("similarity").alias("_s"),
    )
    totals = per_bucket.groupBy("user_id").agg(
        F.sum("clusters").alias("total_clusters"), F.sum("faces").alias("total_faces"),
        F.round(F.sum("_s") / F.sum("clusters"), 4).alias("average_similarity"),
    )
    return per_bucket.drop("_s").join(totals, "user_id")


def user_assignments_grouped(
    assignments: DataFrame,
    run_id: str | None = None,
    bucket: str | None = None,
    sub_bucket: str | None = None,
) -> DataFrame:
    """Per user and run: clusters, faces, mean similarity (4 digits), filtered.

    Bucket and sub-bucket together match exactly, a bucket alone as a prefix, and a
    sub-bucket alone as a suffix (the original ignores the last case).
    """
    path, kept = F.col("bucket_path"), assignments
    if run_id is not None:
        kept = kept.where(F.col("run_id") == run_id)
    if bucket and sub_bucket:
        kept = kept.where(path == f"{bucket}/{sub_bucket}")
    elif bucket:
        kept = kept.where(path.startswith(f"{bucket}/"))
    elif sub_bucket:
        kept = kept.where(path.endswith(f"/{sub_bucket}"))
    return kept.groupBy("user_id", "run_id", "bucket_path").agg(
        F.count(F.lit(1)).alias("cluster_count"), F.sum("face_count").alias("total_faces"),
        F.round(F.avg("similarity"), 4).alias("avg_similarity"),
    )


def run_assignment_info(assignments: DataFrame) -> DataFrame:
    """Per run: assignments, distinct users, mean similarity."""
    return assignments.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_assigned"), F.countDistinct("user_id").alias("total_users"),
        F.avg("similarity").alias("avg_similarity"),
    )


def threshold_match(
    profiles: DataFrame, members: DataFrame, member: str, vector: str, threshold: float = 0.7, **layout_options
) -> DataFrame:
    """(user_id, member, similarity) for cosines strictly over ``threshold``."""
    pairs = similarity_cross_join(
        members, profiles, member, vector, "user_id", "unit", threshold, strict=True, **layout_options
    )
    return pairs.select(F.col("b").alias("user_id"), F.col("a").alias(member), "similarity")


def identify_in_clusters(
    profiles: DataFrame, members: DataFrame, cluster: str, member: str, vector: str, threshold: float = 0.7,
    **layout_options,
) -> DataFrame:
    """Per user and cluster with a match: best similarity, matches and cluster size.

    Best and count are made inside the vector join, so what is shuffled grows with users and clusters.
    """
    found = similarity_groups(
        members, profiles, cluster, member, vector, "user_id", "unit", threshold, strict=True, **layout_options
    )
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("cluster_size"))
    named = found.select(
        F.col("b").alias("user_id"), F.col("a").alias(cluster), F.col("similarity").alias("best_similarity"), F.col("n").alias("matches_count")
    )
    return named.join(sizes, cluster)


def identification_outcome(
    requests: DataFrame, profiles: DataFrame, members: DataFrame, found: DataFrame, cluster: str
) -> DataFrame:
    """``requests`` (user_id, cluster, …) plus outcome, cluster size and number of matches.

    The outcome is empty_cluster, invalid_profile (no usable vector), match or no_match;
    ``found`` is the result of ``identify_in_clusters``.
    """
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    usable = profiles.where(norm("unit") > 0).select("user_id", F.lit(True).alias("_usable"))
    hits = found.select("user_id", cluster, F.col("matches_count").alias("_hits"))
    joined = requests.join(sizes, cluster, "left").join(usable, "user_id", "left")
    joined = joined.join(hits, ["user_id", cluster], "left")
    outcome = (
        F.when(F.col("_size").isNull(), "empty_cluster")
        .when(F.col("_usable").isNull(), "invalid_profile")
        .when(F.col("_hits") > 0, "match")
        .otherwise("no_match")
    )
    return joined.withColumns(
        {
            "outcome": outcome,
            "total_in_cluster": F.coalesce("_size", F.lit(0)),
            "matches_count": F.coalesce("_hits", F.lit(0)),
        }
    ).drop("_size", "_usable", "_hits")


def search_profile_all_clusters(found: DataFrame, cluster: str) -> DataFrame:
    """``identify_in_clusters`` ranked per user, with the user's totals."""
    totals = found.groupBy("user_id").agg(
        F.sum("matches_count").alias("total_matches"), F.count(F.lit(1)).alias("matching_clusters")
    )
    order = [F.desc("best_similarity"), F.asc(cluster)]
    return rank_within(found, ["user_id"], order).join(totals, "user_id")


def filter_points(
    points: DataFrame,
    run_id: str | None = None,
    person_id: str | None = None,
    owner: bool | None = None,
    ids: DataFrame | None = None,
    key: str = "detection_id",
) -> DataFrame:
    """Points by run, person, owner flag or a table of ids; never truncated."""
    kept = points
    if run_id is not None:
        kept = kept.where(F.col("run_id") == run_id)
    if person_id is not None:
        kept = kept.where(F.col("person_id") == person_id)
    if owner is not None:
        kept = kept.where(F.col("is_owner") == F.lit(owner))
    return kept if ids is None else kept.join(ids.select(key).distinct(), key, "left_semi")


def distinct_face_ids(points: DataFrame, key: str = "detection_id") -> DataFrame:
    return points.select(key).where(F.col(key).isNotNull()).distinct()

