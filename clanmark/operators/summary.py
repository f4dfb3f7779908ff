"""Roll-ups of clusters, assets, runs and processing logs.

Tables used: *members* (run_id, cluster_id, detection_id, asset_id, confidence, quality,
is_owner), *clusters* (one row per run and cluster), *runs* (one row per run).
Everything is a two-phase aggregate; "best of" picks are min/max of a struct, so a hot
cluster or run is combined in its map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.functions.quality import owner_score
from clanmark.operators.numbering import first_per

UNASSIGNED = "unassigned"


def _n(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def select_owner(members: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Per cluster: the detection with the best owner score, ties to the lower id."""
    score = owner_score(F.col("quality"), F.col("confidence"))
    entry = F.struct((-score).alias("s"), F.col("detection_id").alias("d"), *extra)
    best = members.groupBy(*keys).agg(F.min(entry).alias("m"))
    return best.select(
        *keys, F.col("m.d").alias("owner_id"), (-F.col("m.s")).alias("owner_score"), *[F.col(f"m.{c}") for c in extra]
    )


def cluster_profile(members: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster: detections, distinct assets, average confidence, best quality.

    Member lists stay in the membership table (``tables.cluster_pages`` nests them).
    """
    return members.groupBy(*keys).agg(
        _n("total_detections"),
        F.countDistinct("asset_id").alias("unique_assets"),
        F.avg("confidence").alias("avg_confidence"),
        F.max(F.coalesce("quality", F.lit(0.0))).alias("best_quality"),
        F.min("detection_id").alias("first_id"),
    )


def asset_overlap(members: DataFrame, keys: list[str] = []) -> DataFrame:
    """Assets with one cluster, with several, the maximum and the average per asset."""
    pairs = members.where(F.col("cluster_id").isNotNull()).select(*keys, "asset_id", "cluster_id").distinct()
    per_asset = pairs.groupBy(*keys, "asset_id").agg(_n("_c"))
    stats = [
        F.count_if(F.col("_c") == 1).alias("single_cluster_assets"),
        F.count_if(F.col("_c") > 1).alias("multi_cluster_assets"),
        F.coalesce(F.max("_c"), F.lit(0)).alias("max_clusters_per_asset"),
        F.coalesce(F.avg("_c"), F.lit(0.0)).alias("avg_clusters_per_asset"),
    ]
    return per_asset.groupBy(*keys).agg(*stats) if keys else per_asset.agg(*stats)


def unassigned_assets(detections: DataFrame, members: DataFrame) -> DataFrame:
    """Assets of ``detections`` that hold no clustered member."""
    held = members.where(F.col("cluster_id").isNotNull()).select("asset_id").distinct()
    return detections.select("asset_id").distinct().join(held, "asset_id", "left_anti")


def run_stats(members: DataFrame, keys: list[str] = []) -> DataFrame:
    """Totals per run, or of one run without ``keys``: a single row, all zero if it is empty."""
    clustered = F.col("cluster_id").isNotNull()
    totals = members.groupBy(*keys).agg(
        F.countDistinct("cluster_id").alias("total_clusters"),
        F.countDistinct("asset_id").alias("total_assets"),
        _n("total_detections"),
        F.count_if(~clustered).alias("unassigned_detections"),
        F.count_if(clustered).alias("_in"),
    )
    average = F.coalesce(F.try_divide(F.col("_in"), F.col("total_clusters")), F.lit(0.0))
    return totals.withColumn("avg_per_cluster", average).drop("_in")


def clusters_by_size(clusters: DataFrame, size: str, key: str) -> DataFrame:
    return clusters.orderBy(F.desc(size), F.asc(key))


def size_histogram(sizes: DataFrame, size: str = "size") -> DataFrame:
    """Two bucketings of cluster sizes, the largest and the mean.  Singletons fit no bucket."""
    s = F.col(size)
    return sizes.agg(
        _n("n_clusters"),
        F.count_if(s.between(2, 5)).alias("small_2_5"),
        F.count_if(s.between(6, 15)).alias("medium_6_15"),
        F.count_if(s >= 16).alias("large_16_up"),
        F.count_if(s.between(2, 3)).alias("small_2_3"),
        F.count_if(s.between(4, 8)).alias("medium_4_8"),
        F.count_if(s >= 9).alias("large_9_up"),
        F.coalesce(F.max(s), F.lit(0)).alias("largest"),
        F.coalesce(F.round(F.avg(s), 2), F.lit(0.0)).alias("mean_size"),
    )


def quality_tiers(members: DataFrame, quality: str = "quality", label: str = "cluster_id") -> DataFrame:
    """Counts of high (> 0.7), medium and low (< 0.4) quality, averages and noise ratio."""
    q = F.coalesce(F.col(quality), F.lit(0.0))
    noise = F.count_if(F.col(label).isNull())
    return members.agg(
        _n("total"),
        noise.alias("noise_count"),
        F.coalesce(F.round(F.try_divide(noise, F.count(F.lit(1))), 3), F.lit(0.0)).alias("noise_ratio"),
        F.round(F.avg(q), 3).alias("avg_quality"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("avg_confidence"),
        F.round(F.avg(F.coalesce(F.col("blur").cast("double"), F.lit(0.0))), 1).alias("avg_blur"),
        F.count_if(q > 0.7).alias("high_quality"),
        F.count_if((q >= 0.4) & (q <= 0.7)).alias("medium_quality"),
        F.count_if(q < 0.4).alias("low_quality"),
    )


def faces_per_asset(detections: DataFrame) -> DataFrame:
    """Detections before any filter: total, assets, average per asset (2 digits)."""
    totals = detections.agg(_n("total_detections"), F.countDistinct("asset_id").alias("n_assets"))
    average = F.coalesce(F.round(F.try_divide("total_detections", "n_assets"), 2), F.lit(0.0))
    return totals.withColumn("avg_per_asset", average)


def person_vector_stats(points: DataFrame) -> DataFrame:
    """Per run and person: vectors, owner flags, average confidence (unreadable skipped).

    ``confidence`` may be text.  The row of ``unassigned`` is part of the result.
    """
    person = F.coalesce(F.col("person_id"), F.lit("unknown"))
    sure = F.col("confidence").cast("string").try_cast("double")
    return points.groupBy("run_id", person.alias("person_id")).agg(
        _n("total_vectors"),
        F.count_if(F.coalesce("is_owner", F.lit(False))).alias("owner_vectors"),
        F.coalesce(F.avg(sure), F.lit(0.0)).alias("avg_confidence"),
    )


def cluster_vector_stats(points: DataFrame, noise: str = "noise") -> DataFrame:
    """Per run: vectors, clusters with vectors, noise vectors."""
    label = F.coalesce(F.col("person_id"), F.lit("unknown"))
    return points.groupBy("run_id").agg(
        _n("total_vectors"),
        F.countDistinct(F.when(label != noise, label)).alias("clusters_with_vectors"),
        F.count_if(label == noise).alias("noise_vectors"),
    )


def cluster_vector_counts(points: DataFrame, noise: str = "noise") -> DataFrame:
    label = F.coalesce(F.col("person_id"), F.lit("unknown"))
    return points.where(label != noise).groupBy("run_id", label.alias("person_id")).agg(_n("n_vectors"))


def run_overview(points: DataFrame) -> DataFrame:
    """Per run: persons, faces, assignment rate (%), faces per person, owner flags."""
    person = F.coalesce(F.col("person_id"), F.lit("unknown"))
    totals = points.groupBy("run_id").agg(
        F.countDistinct(F.when(person != UNASSIGNED, person)).alias("total_persons"),
        _n("total_faces"),
        F.count_if(person == UNASSIGNED).alias("unassigned_faces"),
        F.count_if(F.coalesce("is_owner", F.lit(False))).alias("owner_count"),
    )
    assigned = F.col("total_faces") - F.col("unassigned_faces")
    rate = F.round(F.try_divide(assigned, "total_faces") * 100, 1)
    return totals.withColumns(
        {
            "assignment_rate": F.coalesce(rate, F.lit(0.0)),
            "avg_per_person": F.coalesce(F.round(F.try_divide("total_faces", "total_persons"), 1), F.lit(0.0)),
        }
    )


def run_overview_top(points: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest persons per run with their owner's asset; ``unassigned`` is no person."""
    stats = person_vector_stats(points).where(F.col("person_id") != UNASSIGNED)
    top = first_per(stats, ["run_id"], [F.desc("total_vectors"), F.asc("person_id")], k, "rank")
    owners = points.where(F.coalesce("is_owner", F.lit(False))).groupBy("run_id", "person_id").agg(
        F.min(F.struct("detection_id", "asset_id")).alias("o")
    )
    joined = top.join(owners, ["run_id", "person_id"], "left")
    return joined.select(
        "run_id", "rank", "person_id", "total_vectors", F.round("avg_confidence", 3).alias("avg_confidence"),
        F.col("o.detection_id").alias("owner_id"), F.col("o.asset_id").alias("owner_asset"),
    )


def run_status_top(clusters: DataFrame, members: DataFrame, k: int = 5, samples: int = 3) -> DataFrame:
    """The ``k`` clusters with most assets per run, each with its first sample assets."""
    top = first_per(clusters, ["run_id"], [F.desc("unique_assets"), F.asc("cluster_id")], k, "person_rank")
    pairs = members.join(top.select("run_id", "cluster_id"), ["run_id", "cluster_id"], "left_semi")
    pairs = pairs.select("run_id", "cluster_id", "asset_id").distinct()
    first = first_per(pairs, ["run_id", "cluster_id"], [F.asc("asset_id")], samples)
    shown = first.groupBy("run_id", "cluster_id").agg(
        F.sort_array(F.collect_list("asset_id")).alias("sample_assets")
    )
    return top.join(shown, ["run_id", "cluster_id"], "left")


def run_history(runs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Runs newest first per bucket, with their assignment counts and an ``is_latest`` flag."""
    counts = assignments.groupBy("run_id").agg(_n("_a"))
    newest = latest_run(runs).select("run_id", F.lit(True).alias("_l"))
    joined = runs.join(counts, "run_id", "left").join(newest, "run_id", "left")
    flagged = joined.withColumns(
        {"assignments_count": F.coalesce("_a", F.lit(0)), "is_latest": F.coalesce("_l", F.lit(False))}
    ).drop("_a", "_l")
    return flagged.orderBy("bucket", "sub_bucket", F.desc("ts"), "run_id")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every (bucket, sub-bucket), ties to the lower run id."""
    return first_per(runs, ["bucket", "sub_bucket"], [F.desc("ts"), F.asc("run_id")])


def person_details(members: DataFrame) -> DataFrame:
    """Per run and cluster: appearances, owner (flagged, else first), confidence, quality."""
    pick = F.struct((~F.coalesce("is_owner", F.lit(False))).alias("o"), "detection_id", "asset_id")
    grouped = members.where(F.col("cluster_id").isNotNull()).groupBy("run_id", "cluster_id").agg(
        _n("total_appearances"),
        F.min(pick).alias("p"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"),
        F.max(F.coalesce("quality", F.lit(0.0))).alias("best_quality"),
    )
    return grouped.withColumns(
        {"owner_id": F.col("p.detection_id"), "owner_asset": F.col("p.asset_id")}
    ).drop("p")


def run_statistics_top(clusters: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` clusters with most assets of every run."""
    return first_per(clusters, ["run_id"], [F.desc("unique_assets"), F.asc("cluster_id")], k, "rank")


def processing_rollup(log: DataFrame, keys: list[str]) -> DataFrame:
    """Throughput and success of a processing log (status, seconds, faces, valid_faces)."""
    done = F.count_if(F.col("status") == "processed")
    grouped = log.groupBy(*keys).agg(
        _n("total_files"),
        done.alias("processed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.sum("seconds").alias("total_seconds"),
    )

    def ratio(a: Column, b: Column, digits: int) -> Column:
        return F.coalesce(F.round(F.try_divide(a, b), digits), F.lit(0.0))

    return grouped.withColumns(
        {
            "success_rate_percent": ratio(F.col("processed_files") * 100.0, F.col("total_files"), 1),
            "files_per_second": ratio(F.col("processed_files").cast("double"), F.col("total_seconds"), 2),
            "avg_seconds_per_file": ratio(F.col("total_seconds"), F.col("total_files"), 3),
        }
    ).withColumn("total_seconds", F.round("total_seconds", 2))


def clustering_rollup(members: DataFrame) -> DataFrame:
    """Per run: faces per asset and clusters per 100 valid faces."""
    valid = F.col("cluster_id").isNotNull()
    grouped = members.groupBy("run_id").agg(
        _n("total_faces"), F.count_if(valid).alias("valid_faces"),
        F.countDistinct("asset_id").alias("n_assets"), F.countDistinct("cluster_id").alias("num_clusters"),
    )
    return grouped.withColumns(
        {
            "faces_per_asset": F.coalesce(F.round(F.try_divide("total_faces", "n_assets"), 2), F.lit(0.0)),
            "clustering_efficiency": F.coalesce(
                F.round(F.try_divide(F.col("num_clusters") * 100.0, F.col("valid_faces")), 1), F.lit(0.0)
            ),
        }
    )


def cluster_members(members: DataFrame, run_id: str, cluster_id: int) -> DataFrame:
    return members.where((F.col("run_id") == run_id) & (F.col("cluster_id") == cluster_id)).select(
        "run_id", "cluster_id", "detection_id", "asset_id", "confidence", "quality", "is_owner"
    )
