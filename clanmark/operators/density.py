"""Density clustering on cosine or euclidean distance of unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clanmark.operators.components import connected_components
from clanmark.operators.similarity import (
    neighbour_counts,
    similarity_cross_join,
    similarity_forest,
)
from clanmark.sources.workspace import materialize

NOISE = "noise"


def similarity_bound(eps: float, metric: str) -> float:
    """The cosine that a distance of ``eps`` between unit vectors stands for."""
    if metric == "cosine":
        return 1.0 - eps
    if metric == "euclidean":
        return 1.0 - eps * eps / 2.0
    raise ValueError("metric is 'cosine' or 'euclidean'")


def dbscan(
    df: DataFrame,
    key: str,
    vector: str,
    eps: float = 0.25,
    min_samples: int = 2,
    metric: str = "cosine",
    **layout_options,
) -> DataFrame:
    """(key, cluster): lowest core id of the cluster, NULL for noise.

    A row is core if it has ``min_samples`` rows within ``eps``, itself included.
    Clusters are components of the core rows; a border row joins the cluster with the
    lowest id among its core neighbours.  With ``min_samples`` of 2 every row with a
    neighbour is core, so no neighbour counts are needed.
    """
    bound = similarity_bound(eps, metric)
    ids = df.select(key)
    if min_samples <= 1:
        parts = similarity_forest(df, key, vector, bound, **layout_options)
        return connected_components(parts, ids, key).withColumnRenamed("component", "cluster")
    if min_samples == 2:
        edges = materialize(similarity_forest(df, key, vector, bound, **layout_options), "edges")
        labelled = connected_components(edges, ids, key)
        # noise is what no edge touches: a join on the unique key, not on the component
        ends = edges.select(F.col("a").alias(key)).unionByName(edges.select(F.col("b").alias(key)))
        touched = ends.distinct().withColumn("_touched", F.lit(True))
        joined = labelled.join(touched, key, "left")
        return joined.select(key, F.when(F.col("_touched"), F.col("component")).alias("cluster"))

    counts = neighbour_counts(df, key, vector, bound, **layout_options)
    core_ids = counts.where(F.col("n") + 1 >= min_samples).select(F.col("id").alias(key))
    core_ids = materialize(core_ids, "core")
    core = materialize(df.select(key, vector).join(core_ids, key, "left_semi"), "core")
    border = df.select(key, vector).join(core_ids, key, "left_anti")
    labelled = connected_components(
        similarity_forest(core, key, vector, bound, **layout_options), core_ids, key
    )
    labelled = materialize(labelled, "core")
    # a border row has fewer than min_samples neighbours, so this table stays small
    reach = similarity_cross_join(border, core, key, vector, key, vector, bound, **layout_options)
    reached = reach.join(labelled.withColumnRenamed(key, "b"), "b")
    reached = reached.groupBy("a").agg(F.min("component").alias("cluster"))
    found = labelled.select(key, F.col("component").alias("cluster")).unionByName(
        reached.select(F.col("a").alias(key), "cluster")
    )
    return ids.join(found, key, "left")
