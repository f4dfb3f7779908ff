"""Inputs of the registered queries, derived from the given tables by Spark.

``detections`` plants groups of similar vectors: a shared base, a sub-group and own
noise, all taken from ``embeddings``.  Every other input follows from it or from
``events``, so the work of every query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clanmark.functions.vectors import l2_normalize
from clanmark.operators.assign import assign_clusters, load_profiles
from clanmark.operators.components import similarity_components
from clanmark.operators.summary import asset_overlap, cluster_profile, select_owner
from clanmark.sources.tables import run_document, vector_points
from clanmark.sources.workspace import materialize

# Run name, similarity threshold, time, and whether singletons are unassigned.
RUNS = (
    ("r1", 0.75, "2024-02-01 00:00:00", False),
    ("r2", 0.85, "2024-02-02 00:00:00", True),
)

_stored: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    vector = F.col("embedding").cast("array<double>").alias("vector")
    return table(spark, folder, "embeddings").select("vec_id", vector, "label")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v")
    )
    g, s = F.expr("i div 10"), F.expr("(i % 10) div 4")
    own = e.withColumns({"g": g, "base_id": g * 10, "part_id": g * 10 + s * 4})
    base = e.select(F.col("i").alias("base_id"), F.col("v").alias("base"))
    part = e.select(F.col("i").alias("part_id"), F.col("v").alias("part"))
    joined = own.join(base, "base_id").join(part, "part_id").withColumns(
        {"k1": 0.6 + F.lit(0.15) * (F.col("g") % 4), "k2": 0.3 + F.lit(0.15) * (F.col("i") % 3)}
    )
    shared = F.zip_with("base", "part", lambda x, y: x + F.col("k1") * y)
    raw = joined.withColumn("vector", F.zip_with(shared, "v", lambda x, y: x + F.col("k2") * y))
    i = F.col("i")
    asset = F.when(F.col("g") % 5 == 0, F.col("g") + 1000).otherwise(i * 7 % 60)
    made = raw.select(
        i.alias("detection_id"),
        asset.alias("asset_id"),
        F.lit("photos").alias("bucket"),
        F.when(asset % 2 == 0, "a").otherwise("b").alias("sub_bucket"),
        (F.lit(0.4) + (i * 37 % 60) / 100.0).alias("confidence"),
        (i * 13 % 90 + 20).alias("w"),
        (i * 17 % 90 + 20).alias("h"),
        (i * 5 % 400).alias("x"),
        (i * 3 % 300).alias("y"),
        F.lit(640).alias("image_w"),
        F.lit(480).alias("image_h"),
        (i * 29 % 320).alias("blur"),
        "vector",
    )
    return made.withColumns(
        {"quality": F.col("confidence") * (F.col("w") * F.col("h")), "unit": l2_normalize("vector")}
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per 20 embeddings: the vector with the lowest id of the twenty."""
    k = F.expr("vec_id div 20")
    first = embeddings(spark, folder).groupBy(k.alias("k")).agg(
        F.min(F.struct("vec_id", "vector")).alias("m")
    )
    return first.select(
        F.format_string("user_%06d", "k").alias("user_id"),
        F.col("m.vector").alias("embedding"),
        (F.lit(0.5) + (F.col("k") % 50) / 100.0).alias("confidence"),
        (F.col("k") * 1.5).alias("quality_score"),
        F.array(*[(F.col("k") * n % 300).cast("double") for n in (3, 5, 7, 11)]).alias("bbox"),
    )


def submitted_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with flaws spread over the table, for validation."""
    k = F.substring("user_id", 6, 6).cast("long")
    empty = F.array().cast("array<double>")
    return profiles(spark, folder).withColumn("k", k).select(
        F.when(F.col("k") % 7 == 1, F.concat(F.lit("bad id "), F.col("k").cast("string")))
        .when(F.col("k") % 7 == 2, F.lit("x"))
        .otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("k") % 5 == 1, empty).otherwise(F.col("embedding")).alias("embedding"),
        F.when(F.col("k") % 4 == 1, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("k") % 6 == 1, F.lit(-1.0)).otherwise(F.col("quality_score")).alias("quality_score"),
        F.when(F.col("k") % 3 == 1, F.slice("bbox", 1, 3)).otherwise(F.col("bbox")).alias("bbox"),
        "k",
    )


def _run(det: DataFrame, name: str, threshold: float, at: str, singles_out: bool) -> DataFrame:
    parts = similarity_components(det, "detection_id", "unit", threshold)
    if singles_out:
        sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        label = F.when(F.col("_n") > 1, F.col("component"))
        parts = parts.join(sizes, "component").select("detection_id", label.alias("cluster_id"))
    else:
        parts = parts.withColumnRenamed("component", "cluster_id")
    columns = ["detection_id", "asset_id", "bucket", "sub_bucket", "confidence", "quality", "blur", "unit"]
    return det.select(*columns).join(parts, "detection_id").withColumns(
        {"run_id": F.concat(F.lit(name), "sub_bucket"), "ts": F.lit(at).cast("timestamp")}
    )


def _once(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """Result tables are written once per session, as a clustering run would leave them."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        _stored[key] = materialize(build(spark, folder), name)
    return _stored[key]


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Stored members of two clusterings, one run per sub-bucket each."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        det = materialize(detections(spark, folder), "detections")
        runs = [_run(det, *run) for run in RUNS]
        together = materialize(runs[0].unionByName(runs[1]), "members")
        clustered = together.where(F.col("cluster_id").isNotNull())
        owner = select_owner(clustered, ["run_id", "cluster_id"]).select(
            "run_id", F.col("owner_id").alias("detection_id"), F.lit(True).alias("_o")
        )
        flagged = together.join(owner, ["run_id", "detection_id"], "left")
        return flagged.withColumn("is_owner", F.coalesce("_o", F.lit(False))).drop("_o")

    return _once(spark, folder, "members", build)


def points(spark: SparkSession, folder: str) -> DataFrame:
    return vector_points(members(spark, folder))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = members(spark, folder).where(F.col("cluster_id").isNotNull())
    keys = ["run_id", "cluster_id"]
    owners = rows.where("is_owner").select(*keys, F.col("detection_id").alias("owner_id"), F.col("unit").alias("owner_unit"))
    made = cluster_profile(rows, keys).join(owners, keys)
    return made.withColumn("cluster_key", F.concat_ws("/", "run_id", F.col("cluster_id").cast("string")))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = members(spark, folder)
    places = rows.groupBy("run_id").agg(
        F.min("bucket").alias("bucket"), F.min("sub_bucket").alias("sub_bucket"), F.min("ts").alias("ts")
    )
    return run_document(rows, asset_overlap(rows, ["run_id"])).join(places, "run_id")


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        known = load_profiles(profiles(spark, folder))
        cl = materialize(clusters(spark, folder), "clusters")
        found = assign_clusters(cl.select("cluster_key", "owner_unit"), known)
        at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-02-03 00:00:00").cast("timestamp")) + F.col("cluster_id") * 60)
        slim = cl.select("cluster_key", "run_id", "cluster_id", F.col("total_detections").alias("face_count"))
        path = F.concat(F.lit("photos/"), F.substring("run_id", 3, 1))
        return found.join(slim, "cluster_key").drop("cluster_key").withColumns(
            {"bucket_path": path, "created_at": at, "updated_at": at}
        )

    return _once(spark, folder, "assignments", build)


def asset_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Object-store keys of all kinds, one per event, with a byte length."""
    i = F.col("event_id")
    endings = F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".webp", ".txt", ".tiff", "/")])
    ext = F.get(endings, (i % 7).cast("int"))
    number = i.cast("string")
    key = (
        F.when(i % 11 == 3, F.concat(F.lit("user-profiles/u"), number))
        .when(i % 11 == 4, F.concat(F.lit("user-profiles/u"), number, F.lit("/face"), ext))
        .when(i % 11 == 5, F.concat(F.lit("temp-uploads/s"), number, F.lit("/a/b"), ext))
        .when(i % 11 == 6, F.concat(F.lit("lonely"), number))
        .when(i % 11 == 7, F.concat(F.lit("/anonymous-images/b"), number))
        .when(i % 11 == 8, F.lit("anonymous-images/batch_3/"))
        .otherwise(F.concat(F.lit("anonymous-images/batch_"), (i % 7).cast("string"), F.lit("/img_"), number, ext))
    )
    return table(spark, folder, "events").select(
        "event_id", key.alias("key"), (i * 7919 % 30_000_000).alias("length")
    )


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Names, e-mails and ids with flaws, one per event."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    number = i.cast("string")
    kind = i % 8
    raw = (
        F.when(kind == 0, F.concat(F.lit("My Batch "), number))
        .when(kind == 1, F.concat(F.lit("__A__b__"), number, F.lit("__")))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.concat(F.lit("café-"), number, F.lit(".PNG")))
        .when(kind == 4, F.lit("___"))
        .when(kind == 5, F.concat(F.lit("x.y."), number, F.lit(".jpeg")))
        .when(kind == 6, F.concat(F.lit("user."), u, F.lit("@site-"), number))
        .otherwise(F.concat(F.lit("plain_"), number))
    )
    mail = F.when(i % 3 == 0, F.concat(F.lit("user"), u, F.lit("@example.org")))
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", raw.alias("name"), mail.alias("email"), "ts"
    )


def processing_log(spark: SparkSession, folder: str) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "purchase", "processed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("other")
    )
    return table(spark, folder, "events").select(
        "event_id", "user_id", status.alias("status"), F.col("value").alias("seconds")
    )


def run_documents(spark: SparkSession, folder: str) -> DataFrame:
    """JSON run documents in six layouts, ten cluster entries each."""
    i = F.col("detection_id")
    number = i.cast("string")
    entry = F.concat(
        F.lit('{"person_id":"person_'), number, F.lit('","cluster_id":"c'), number,
        F.lit('","size":'), F.col("w").cast("string"), F.lit(',"owner_embedding":[1.0,0.5]}'),
    )
    g, p = F.expr("detection_id div 10"), i % 10
    layout = g % 6
    # a numbered map of layout 1 lacks "7", one of layout 4 lacks "5"
    gap = ((layout == 1) & (p == 7)) | ((layout == 4) & (p == 5))
    numbered = F.when(layout.isin(1, 4), F.concat(F.lit('"'), p.cast("string"), F.lit('":'), entry)).otherwise(entry)
    rows = detections(spark, folder).select(
        g.alias("doc_id"), layout.alias("kind"), F.struct(p.alias("p"), F.when(~gap, numbered).alias("e")).alias("s")
    )
    docs = rows.groupBy("doc_id", "kind").agg(F.sort_array(F.collect_list("s")).alias("s"))
    joined = F.array_join(F.array_compact(F.col("s.e")), ",")
    kind = F.col("kind")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"bucket_path":"x","person_clusters":['), joined, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('{"person_clusters":{'), joined, F.lit("}}")))
        .when(kind == 2, F.concat(F.lit('{"clusters":['), joined, F.lit("]}")))
        .when(kind == 3, F.concat(F.lit("["), joined, F.lit("]")))
        .when(kind == 4, F.concat(F.lit("{"), joined, F.lit("}")))
        .otherwise(
            F.concat(
                F.lit('{"unassigned_faces":[{"cluster_id":"z"}],"note":"n","tags":["t"],"entries":['),
                joined, F.lit("]}"),
            )
        )
    )
    return docs.select("doc_id", text.alias("document"))
