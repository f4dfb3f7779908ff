"""Connected components of an edge table.

Each round first contracts the edges that already sit in one task (a combiner: no
group is gathered for it), then does one large-star and one small-star step
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).  The star
steps are a partially aggregated minimum plus an equi-join, so a hub costs one row per
map task in the aggregate and its join partition is split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clanmark.operators.numbering import number_rows
from clanmark.operators.similarity import merge_labels, similarity_forest
from clanmark.sources.workspace import materialize, release

CONTRACT_ROWS = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """Star edges (a > b) of what is connected within the same slice of a task."""

    def stars(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
        ids = pa.concat_arrays([a, b]).unique()
        ids = ids.take(pc.sort_indices(ids))
        left = np.asarray(pc.index_in(a, ids), dtype=np.int64)
        right = np.asarray(pc.index_in(b, ids), dtype=np.int64)
        labels = merge_labels(np.arange(len(ids)), left, right)
        child = np.flatnonzero(labels != np.arange(len(ids)))
        columns = [ids.take(pa.array(child)), ids.take(pa.array(labels[child]))]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CONTRACT_ROWS:
                yield _joined(held)
                held, rows = [], 0
        if rows:
            yield _joined(held)

    def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return stars(table.column(0).combine_chunks(), table.column(1).combine_chunks())

    together = edges.select("a", "b").hint("rebalance", "a")
    return together.mapInArrow(contract, edges.select("a", "b").schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low"))
    lowest = lowest.withColumn("low", F.least("a", "low"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    rest = edges.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.unionByName(lowest.withColumnRenamed("low", "b")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is itself a child."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("v"), one.alias("child"), none.alias("parent")).unionByName(
        edges.select(F.col("b").alias("v"), none.alias("child"), one.alias("parent"))
    )
    seen = ends.groupBy("v").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return seen.where("c > 1 OR (c = 1 AND p = 1)").isEmpty()


def component_edges(edges: DataFrame) -> DataFrame:
    """(a, b) for every vertex a that is not the lowest id b of its component."""
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    forest = materialize(_contract(oriented), "forest")
    while not _is_star(forest):  # every round shortens what is no star yet
        before = forest
        forest = materialize(_contract(_small_star(_large_star(before))), "forest")
        release(before)
    return forest


def connected_components(edges: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """``vertices`` plus ``component``: the lowest id it is connected to (itself if alone)."""
    forest = component_edges(edges).select(F.col("a").alias(key), F.col("b").alias("_low"))
    joined = vertices.join(forest, key, "left")
    return joined.withColumn("component", F.coalesce("_low", key)).drop("_low")


def similarity_components(
    df: DataFrame, key: str, vector: str, threshold: float = 0.75, **layout_options
) -> DataFrame:
    """(key, component): connected components of the graph cosine >= ``threshold``.

    Rows without a direction (null, zero or non-finite vectors) stay on their own.
    """
    edges = similarity_forest(df, key, vector, threshold, **layout_options)
    return connected_components(edges, df.select(key), key)


def name_components(parts: DataFrame, component: str = "component", name: str = "person_id") -> DataFrame:
    """``parts`` plus ``person_0``, ``person_1``, … in the order of the components."""
    numbers = number_rows(parts.select(component).distinct(), [F.asc(component)], "_k")
    named = parts.join(numbers, component)
    return named.withColumn(name, F.concat(F.lit("person_"), F.col("_k").cast("string"))).drop("_k")
