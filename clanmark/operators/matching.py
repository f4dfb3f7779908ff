"""Greedy pairwise merging of near-duplicate clusters.

The scan takes an edge unless an earlier one that shares a vertex was taken.  Three facts about that let
many edges be decided at a time, each exactly as the scan decides them:

* an edge with no earlier edge at either end is taken;
* an edge with a single earlier edge at its ends is taken if and only if that one is not, so along a chain of such
  edges the answer alternates, and doubled pointers with a parity reach the head of a chain of any length in
  logarithmically many steps;
* the first edges of a component in scan order decide themselves, whatever comes later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.functions.vectors import dimension_of, mean_vectors
from clanmark.operators.components import connected_components
from clanmark.operators.numbering import first_per, running_sum
from clanmark.operators.similarity import similarity_self_join
from clanmark.sources.workspace import fresh_path, materialize, release

SCAN_EDGES = 50_000
#: Edges of a vertex that the scan of a large component looks at: the lowest ones.
SCAN_WIDTH = 16


def _scan(edges: DataFrame) -> DataFrame:
    """Greedy choice over the edges of every component, which sit in one task, in order.

    ``whole`` says whether a vertex has all its edges here.  Where it has not and all of them go to used
    vertices, the choice is open, and the component is left there.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, at, complete, blocked = None, set(), None, True, False
        for batch in batches:
            component, a, b, whole = (batch.column(i).to_pylist() for i in range(4))
            taken = []
            for k in range(len(a)):
                if component[k] != current:
                    current, used, at, complete, blocked = component[k], set(), None, True, False
                if a[k] != at:  # the vertex before, free and cut short, could have taken an edge that is not here
                    blocked = blocked or not (complete or at in used)
                    at, complete = a[k], whole[k]
                if not blocked and a[k] not in used and b[k] not in used:
                    used.update((a[k], b[k]))
                    taken.append(k)
            yield batch.take(pa.array(taken, pa.int64())).select(["a", "b"])

    ordered = edges.select("component", "a", "b", "whole").repartition("component")
    ordered = ordered.sortWithinPartitions("component", "a", "b")
    return ordered.mapInArrow(scan, edges.select("a", "b").schema)


def _beginnings(edges: DataFrame, scan_edges: int) -> DataFrame:
    """The first ``scan_edges`` edges of every large component, of each vertex the lowest ones."""
    width = min(SCAN_WIDTH, scan_edges)
    sizes = edges.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    low = first_per(edges.select("component", "a", "b"), ["a"], [F.asc("b")], width, "_place").join(sizes, "a")
    numbered = running_sum(low, [F.asc("a"), F.asc("b")], "_at", keys=["component"])
    # the last vertex may have more of its lowest edges beyond the cut
    last = Window.partitionBy("component").orderBy(F.desc("_at"))
    here = numbered.where(F.col("_at") <= scan_edges).withColumn("_end", F.first("a").over(last))
    whole = (F.col("_n") <= width) & ((F.col("a") != F.col("_end")) | (F.col("_n") == 1))
    return here.select("component", "a", "b", whole.alias("whole"))


def _first_two(edges: DataFrame) -> DataFrame:
    """(v, e, place): the two earliest edges of every vertex."""
    pair = F.struct("a", "b").alias("e")
    ends = edges.select(F.col("a").alias("v"), pair).unionByName(edges.select(F.col("b").alias("v"), pair))
    return first_per(ends, ["v"], [F.asc("e")], 2, "place")


def _chains(edges: DataFrame) -> DataFrame:
    """(e, p, odd) of the edges with at most one earlier edge p at their ends; a head points to itself.

    Such an edge is among the first two of both its ends: first at both (a head), or first at one end and
    second at the other, whose first edge is the earlier one.
    """
    firsts = materialize(_first_two(edges), "firsts")
    head = firsts.where("place = 1").select(F.col("v").alias("_v"), F.col("e").alias("p"))
    joined = firsts.join(head, F.col("v") == F.col("_v"))
    pointer = F.max(F.when(F.col("place") == 2, F.col("p"))).alias("p")
    both = joined.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.sum("place").alias("places"), pointer)
    kept = both.where("n = 2 AND places <= 3").select("e", F.coalesce("p", "e").alias("p"), F.col("p").isNotNull().alias("odd"))
    chains = materialize(kept, "chains")
    release(firsts)
    return chains


def _shortened(chains: DataFrame) -> DataFrame:
    """Pointers followed inside tasks: the edges of an ascending chain lie next to each other in scan order."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, p = batch.column("e"), batch.column("p")
            place = {pair: k for k, pair in enumerate(zip(e.field(0).to_pylist(), e.field(1).to_pylist()))}
            to = np.array([place.get(x, -1) for x in zip(p.field(0).to_pylist(), p.field(1).to_pylist())], dtype=np.int64)
            here = np.arange(len(to))
            odd, leaf = np.asarray(batch.column("odd")).copy(), np.where(to < 0, here, to)
            odd_steps = np.where(leaf == here, False, odd)
            while not np.array_equal(leaf[leaf], leaf):
                odd_steps, leaf = odd_steps ^ odd_steps[leaf], leaf[leaf]
            # the last edge here may itself point to an edge of another task
            final = odd_steps ^ odd[leaf]
            yield pa.RecordBatch.from_arrays([e, p.take(pa.array(leaf)), pa.array(final)], ["e", "p", "odd"])

    kind = T.StructType([T.StructField(f.name, f.dataType) for f in chains.schema.fields])
    ordered = chains.repartitionByRange(F.asc("e")).sortWithinPartitions("e")
    return ordered.mapInArrow(follow, kind)


def _heads(chains: DataFrame) -> DataFrame:
    """Pointers followed to the head of every chain, twice as far in each step."""
    chains = materialize(_shortened(chains), "chains")
    while True:
        after = chains.select(F.col("e").alias("_e"), F.col("p").alias("_p"), F.col("odd").alias("_odd"))
        moves = chains.where("p <> e").join(after, F.col("p") == F.col("_e"))
        if moves.where("_p <> _e").isEmpty():
            return chains
        joined = chains.join(after, F.col("p") == F.col("_e"), "left")
        odd = F.when((F.col("p") == F.col("e")) | F.col("_odd").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("_odd"))
        before = chains
        chains = materialize(joined.select("e", F.coalesce("_p", "p").alias("p"), odd.alias("odd")), "chains")
        release(before)


def _alternating(edges: DataFrame) -> DataFrame:
    """The edges that are taken of the chains whose head is taken."""
    chains = _heads(_chains(edges))
    heads = chains.where("e = p AND NOT odd").select(F.col("e").alias("_h"))
    reached = chains.join(heads, F.col("p") == F.col("_h"), "left_semi")
    return reached.where("NOT odd").select("e.a", "e.b")


def greedy_matching(edges: DataFrame, scan_edges: int = SCAN_EDGES) -> DataFrame:
    """Pairs taken by a scan of ``edges`` in (a, b) order that skips used endpoints.

    The choice is local to a component of ``edges``.  Components of up to ``scan_edges`` edges are scanned
    in order inside one task.  A larger component is never gathered: each round decides its chains of
    any length and its first ``scan_edges`` edges, drops what they touch and labels what is
    left of it anew, which is the same result, until the pieces that are left are small.
    """
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession, "pairs")
    pair = edges.select("a", "b")
    spark.createDataFrame([], pair.schema).write.parquet(path)
    left = materialize(pair.withColumn("component", F.lit(None).cast(edges.schema["a"].dataType)), "candidates")
    while True:
        vertices = left.select("a").distinct()
        labelled = left.select("a", "b").join(connected_components(left.select("a", "b"), vertices, "a"), "a")
        labelled = materialize(labelled.select("component", "a", "b"), "candidates")
        release(left)
        sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(sizes.where(F.col("n") > scan_edges).select("component"), "large")
        small = labelled.join(large, "component", "left_anti").withColumn("whole", F.lit(True))
        _scan(small).write.mode("append").parquet(path)
        if large.isEmpty():
            release(labelled, large)
            return spark.read.schema(pair.schema).parquet(path)
        rest = materialize(labelled.join(large, "component", "left_semi").select("component", "a", "b"), "candidates")
        release(labelled, large)
        left = _without(rest, materialize(_alternating(rest), "taken"), path)
        left = _without(left, materialize(_scan(_beginnings(left, scan_edges)), "taken"), path)


def _without(edges: DataFrame, taken: DataFrame, path: str) -> DataFrame:
    """``edges`` that touch no vertex of ``taken``, whose pairs are added to the result."""
    taken.write.mode("append").parquet(path)
    touched = taken.select(F.col("a").alias("v")).unionByName(taken.select(F.col("b").alias("v")))
    free = edges.join(touched, F.col("a") == F.col("v"), "left_anti").join(touched, F.col("b") == F.col("v"), "left_anti")
    free = materialize(free, "candidates")
    release(edges, taken)
    return free


def merge_pairs_greedy(
    members: DataFrame,
    cluster: str,
    vector: str,
    threshold: float = 0.85,
    unit: Column | None = None,
    scan_edges: int = SCAN_EDGES,
    **layout_options,
) -> DataFrame:
    """``members`` plus ``merged``: the cluster each row ends in.

    Clusters whose centroids have cosine >= ``threshold`` are candidates; they are
    visited in ascending (lower id, higher id) order and merged only if neither side was
    merged before.  Hence at most pairs, and the order decides, not the similarity.
    """
    vectors = members if unit is None else members.withColumn("_unit", unit)
    column = vector if unit is None else "_unit"
    dim = dimension_of(vectors, column)
    centroids = materialize(mean_vectors(vectors, [cluster], column, dim), "centroids")
    candidates = similarity_self_join(centroids, cluster, "centroid", threshold, dim=dim, **layout_options)
    pairs = greedy_matching(candidates, scan_edges)
    target = pairs.select(F.col("b").alias(cluster), F.col("a").alias("_target"))
    joined = members.join(target, cluster, "left")
    return joined.withColumn("merged", F.coalesce("_target", cluster)).drop("_target")
