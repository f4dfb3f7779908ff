"""Post-processing of a labelling: (key, label) in, (key, label) out.

Noise carries a NULL label.  Sizes and centroids are fixed before anything moves, so
there is no chaining.  Every step works on the cluster table; members only meet it in
one equi-join on the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clanmark.functions.vectors import dimension_of, dot, mean_vectors
from clanmark.operators.components import similarity_components
from clanmark.operators.linkage import agglomerative_average
from clanmark.operators.numbering import number_rows
from clanmark.operators.products import best_products
from clanmark.operators.similarity import top_matches
from clanmark.sources.workspace import materialize


def _relabel(members: DataFrame, label: str, moves: DataFrame) -> DataFrame:
    """Apply (old, new) label moves; ``moves`` has one row per moved cluster."""
    renamed = moves.select(F.col("old").alias(label), F.col("new").alias("_new"))
    joined = members.join(renamed, label, "left")
    return joined.withColumn(label, F.coalesce("_new", label)).drop("_new")


def absorb_small(
    members: DataFrame,
    key: str,
    label: str,
    vector: str,
    min_size: int = 3,
    threshold: float = 1.0 - 0.28,
    **options,
) -> DataFrame:
    """(key, label): small clusters join the large cluster with the closest centroid.

    A cluster below ``min_size`` moves if the cosine is strictly over ``threshold``;
    noise stays.
    """
    kept = members.select(key, label)
    labelled = members.where(F.col(label).isNotNull())
    dim = dimension_of(labelled, vector)
    centroids = materialize(mean_vectors(labelled, [label], vector, dim), "centroids")
    small = centroids.where(F.col("size") < min_size)
    large = centroids.where(F.col("size") >= min_size)
    best = top_matches(
        small, large, label, "centroid", label, "centroid", threshold=threshold, strict=True, dim=dim, **options
    )
    return _relabel(kept, label, best.select(F.col("a").alias("old"), F.col("b").alias("new")))


def absorb_singletons(
    members: DataFrame, key: str, label: str, vector: str, threshold: float = 1.0 - 0.3, **options
) -> DataFrame:
    """Clusters of one join the closest cluster of two or more; every label may be a target."""
    return absorb_small(members, key, label, vector, 2, threshold, **options)


def absorb_small_quality(
    members: DataFrame,
    key: str,
    label: str,
    vector: str,
    quality: str,
    min_size: int = 2,
    threshold: float = 1.0 - 0.3,
    **layout_options,
) -> DataFrame:
    """Like ``absorb_small`` on the plain dot product plus a bonus for good targets.

    Score = dot of the centroids + min(0.1 * average quality of the target, 0.05),
    accepted if strictly over ``threshold``; ties go to the lower label.  The best target of
    every small cluster comes out of the vector join itself.
    """
    kept = members.select(key, label)
    labelled = members.where(F.col(label).isNotNull())
    dim = dimension_of(labelled, vector)
    scores = labelled.groupBy(label).agg(F.avg(F.coalesce(F.col(quality), F.lit(0.0))).alias("q"))
    centroids = mean_vectors(labelled, [label], vector, dim).join(scores, label)
    centroids = materialize(centroids, "centroids")
    small = centroids.where(F.col("size") < min_size)
    large = centroids.where(F.col("size") >= min_size)
    best = best_products(
        small, large, label, "centroid", label, "centroid", threshold, F.least(F.col("q") * 0.1, F.lit(0.05)), dim=dim, **layout_options
    )
    return _relabel(kept, label, best.select(F.col("a").alias("old"), F.col("b").alias("new")))


def merge_components(
    members: DataFrame, key: str, label: str, vector: str, threshold: float = 0.9, **layout_options
) -> DataFrame:
    """Clusters whose centroids are connected at cosine >= ``threshold`` become one."""
    labelled = members.where(F.col(label).isNotNull())
    dim = dimension_of(labelled, vector)
    centroids = materialize(mean_vectors(labelled, [label], vector, dim), "centroids")
    joined = similarity_components(centroids, label, "centroid", threshold, dim=dim, **layout_options)
    moves = joined.select(F.col(label).alias("old"), F.col("component").alias("new"))
    return _relabel(members.select(key, label), label, moves)


def force_merge(
    members: DataFrame, key: str, label: str, vector: str, distance_threshold: float = 0.15, **layout_options
) -> DataFrame:
    """Average linkage over the cluster centroids, by cosine distance."""
    labelled = members.where(F.col(label).isNotNull())
    dim = dimension_of(labelled, vector)
    centroids = materialize(mean_vectors(labelled, [label], vector, dim), "centroids")
    merged = agglomerative_average(centroids, label, "centroid", distance_threshold, dim=dim, **layout_options)
    moves = merged.select(F.col(label).alias("old"), F.col("cluster").alias("new"))
    return _relabel(members.select(key, label), label, moves)


def outliers_to_noise(
    members: DataFrame,
    key: str,
    label: str,
    vector: str,
    quality: str,
    min_quality: float = 0.6,
    deviations: float = 2.0,
) -> DataFrame:
    """Members far from their centroid and of low quality become noise.

    Distance is 1 - dot(vector, centroid) on the vectors as given; far means over
    mean + ``deviations`` population deviations of the cluster.  Missing quality counts
    as 1.  Statistics are aggregates joined back, so a hot cluster is split, not windowed.
    """
    labelled = members.where(F.col(label).isNotNull())
    centroids = materialize(mean_vectors(labelled, [label], vector), "centroids").where("size >= 2")
    measured = labelled.join(centroids, label)
    measured = measured.withColumn("_d", 1.0 - dot(vector, "centroid"))
    measured = measured.select(key, label, "_d", F.coalesce(F.col(quality), F.lit(1.0)).alias("_q"))
    limits = measured.groupBy(label).agg(
        (F.avg("_d") + deviations * F.stddev_pop("_d")).alias("_limit")
    )
    out = measured.join(limits, label).where((F.col("_d") > F.col("_limit")) & (F.col("_q") < min_quality))
    flagged = members.select(key, label).join(
        out.select(key, F.lit(True).alias("_out")), key, "left"
    )
    return flagged.select(key, F.when(F.col("_out").isNull(), F.col(label)).alias(label))


def label_split(members: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, noise): clusters numbered ``cluster_0`` … by size descending, lowest member."""
    noise = members.where(F.col(label).isNull()).select(key)
    sizes = members.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), F.min(key).alias("first_id")
    )
    numbered = number_rows(sizes, [F.desc("size"), F.asc("first_id")], "position")
    named = numbered.withColumn("cluster_id", F.concat(F.lit("cluster_"), F.col("position").cast("string")))
    return named.select("cluster_id", label, "size", "first_id"), noise

