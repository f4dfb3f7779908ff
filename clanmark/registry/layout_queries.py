"""Queries that take the ways of large tables: small units, pivots on two levels, no broadcast, rounds, stored tables.

Each has the SQL of the query that does the same in one unit, or by rewriting the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.operators import refine as R
from clanmark.operators import similarity as O
from clanmark.operators.components import similarity_components
from clanmark.operators.linkage import agglomerative_average
from clanmark.registry import assign_queries as AQ
from clanmark.registry import cluster_queries as C
from clanmark.registry import inputs as I
from clanmark.registry import maintain_queries as M
from clanmark.registry import similarity_queries as S
from clanmark.registry.base import ORACLES, checksum, query
from clanmark.sources import keyed as K
from clanmark.sources.workspace import fresh_path, materialize

UNITS = {"unit_rows_limit": 16, "pivots": 8}


def same_as(other: str):
    """Register under the function's name, with the SQL of another query."""

    def register(build):
        query(build.__name__)(build)
        ORACLES[build.__name__] = ORACLES[other]
        return build

    return register


@same_as("similarity_self_join")
def similarity_self_join_units(spark, d):
    return O.similarity_self_join(I.detections(spark, d), "detection_id", "vector", 0.75, **UNITS)


@same_as("similarity_cross_join")
def similarity_cross_join_units(spark, d):
    det, known = I.detections(spark, d), I.profiles(spark, d)
    pairs = O.similarity_cross_join(
        known, det, "user_id", "embedding", "detection_id", "unit", 0.6, broadcast_bytes=0, **UNITS
    )
    return pairs.withColumnsRenamed({"b": "detection_id", "a": "user_id"})


@same_as("knn_search")
def knn_search_units(spark, d):
    """Two exact steps: the neighbours around the own pivot bound those of the other cells."""
    det = I.detections(spark, d)
    found = O.knn_search(
        I.profiles(spark, d), det, "user_id", "embedding", "detection_id", "unit", 10, broadcast_bytes=0, **UNITS
    )
    payload = det.select(F.col("detection_id").alias("neighbour"), "asset_id", "confidence")
    return found.join(payload, "neighbour")


@same_as("search_profile_all_clusters")
def search_profile_all_clusters_units(spark, d):
    """Best and count per user and cluster are made in the units."""
    return S.search_profile_all_clusters(spark, d, broadcast_bytes=0, unit_rows_limit=8, pivots=4)


@same_as("dbscan")
def similarity_components_units(spark, d):
    """Components over a forest of edges from units and pivots; single rows are noise, as in the other query."""
    parts = materialize(similarity_components(I.detections(spark, d), "detection_id", "unit", 0.75, **UNITS), "parts")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    named = parts.join(sizes, "component")
    return named.select("detection_id", F.when(F.col("n") > 1, F.col("component")).alias("cluster"))


@same_as("agglomerative_average")
def agglomerative_average_rounds(spark, d):
    """Components of three rows or more go through the rounds of mutual nearest partners, those of a unit in a task."""
    return agglomerative_average(I.detections(spark, d), "detection_id", "vector", 0.12, component_rows=2, **UNITS)


@same_as("absorb_small_quality")
def absorb_small_quality_units(spark, d):
    members = C.labels85(spark, d)
    return R.absorb_small_quality(members, "detection_id", "label", "unit", "q", broadcast_bytes=0, **UNITS)


@same_as("absorb_singletons")
def absorb_singletons_units(spark, d):
    members = C.labels85(spark, d)
    return R.absorb_singletons(members, "detection_id", "label", "unit", broadcast_bytes=0, **UNITS)


def stored(spark, df, keys, by=(), buckets=8):
    """The rows as a keyed table of their own in the work folder."""
    return K.create(df, K.KeyedTable(fresh_path(spark, "keyed"), keys, by, buckets))


def stored_points(spark, d):
    return stored(spark, I.points(spark, d), ("detection_id",), ("run_id",))


@same_as("upsert_profile")
def stored_upsert_profile(spark, d):
    table = stored(spark, M.stored_profiles(spark, d), ("user_id",))
    K.upsert_profiles(spark, table, M.profile_patch(spark, d), M.at("2024-03-01 00:00:00"), order="version")
    return K.rows(spark, table).select(
        "user_id", checksum("embedding").alias("weighted"), "confidence", "quality_score", M.stamp("created_at"), M.stamp("updated_at")
    )


@same_as("assignment_upsert")
def stored_assignment_upsert(spark, d):
    before = I.assignments(spark, d)
    table = stored(spark, before, ("run_id", "cluster_id"), ("run_id",))
    K.upsert_assignments(spark, table, AQ.fresh(spark, d), AQ.at("2024-03-01 00:00:00"))
    merged = K.rows(spark, table).select(*before.columns)
    return merged.withColumns({c: AQ.stamp(c) for c in ("created_at", "updated_at")})


@same_as("reassign_members")
def stored_reassign_members(spark, d):
    table = stored_points(spark, d)
    K.reassign(spark, table, M.listed(spark, d), "r2a", "person_x")
    return K.rows(spark, table).select("run_id", "detection_id", "person_id", "is_owner")


@same_as("relabel_members")
def stored_relabel_members(spark, d):
    table = stored_points(spark, d)
    label = F.concat(F.lit("moved_"), F.col("detection_id").cast("string"))
    K.relabel(spark, table, M.listed(spark, d).distinct().withColumn("person_id", label))
    return K.rows(spark, table).select("run_id", "detection_id", "person_id")


@same_as("stamp_run_id")
def stored_stamp_run_id(spark, d):
    table = stored_points(spark, d)
    K.stamp_run(spark, table, M.listed(spark, d), "r9")
    return K.rows(spark, table).select("detection_id", "run_id", "cluster_id")


@same_as("cleanup_run")
def stored_cleanup_run(spark, d):
    """A dry run and then the real one, on folders and footers."""
    tables = {"assignments": stored(spark, I.assignments(spark, d), ("run_id", "cluster_id"), ("run_id",)), "vectors": stored_points(spark, d)}
    parts = []
    for dry in (True, False):
        report = K.cleanup_run(spark, tables["assignments"], tables["vectors"], "r1a", dry)
        left = [(name, K.counted(spark, table).first()["rows"]) for name, table in tables.items()]
        joined = report.join(spark.createDataFrame(left, "step string, left_over long"), "step")
        parts.append(joined.withColumn("step", F.concat("step", F.lit("_dry" if dry else ""))))
    return parts[0].unionByName(parts[1])


@query(
    "stored_lookup",
    """SELECT run_id, detection_id, person_id FROM members WHERE detection_id IN (SELECT owner_id FROM clusters WHERE run_id = 'r2b')""",
)
def stored_lookup(spark, d):
    owners = I.clusters(spark, d).where("run_id = 'r2b'").select(F.col("owner_id").alias("detection_id"))
    return K.lookup(spark, stored_points(spark, d), owners).select("run_id", "detection_id", "person_id")
