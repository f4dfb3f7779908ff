"""Result tables: detections, vectors, runs, and what is read back from them.

All tables are Parquet, partitioned by run, with native types.  Clusters stay flat; a
nested document is only made at the edge, in pages of bounded length, because one
cluster may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.operators.numbering import first_per, rank_within

UNASSIGNED = "unassigned"


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Write or replace the partitions that ``df`` touches, and no others.

    The rebalance gives few files per partition and splits a hot one over several tasks.
    """
    writer = df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def write_detections(members: DataFrame, path: str) -> None:
    """One metadata row per (detection, cluster), without the vector."""
    write_partitioned(members.drop("unit", "vector"), path, ["run_id"])


def vector_points(members: DataFrame, run_id: str = "run_id", key: str = "detection_id") -> DataFrame:
    """Vector rows with a repeatable point id; rows without a cluster are ``unassigned``."""
    from clanmark.functions.paths import point_id

    return members.withColumns(
        {
            "point_id": point_id(F.col(key).cast("string"), F.col(run_id)),
            "person_id": F.coalesce(F.col("cluster_id").cast("string"), F.lit(UNASSIGNED)),
        }
    )


def write_vectors(members: DataFrame, path: str) -> None:
    write_partitioned(vector_points(members), path, ["run_id"])


def write_runs(runs: DataFrame, path: str) -> None:
    """One row per run, in a partition of its own: other runs of the bucket stay."""
    write_partitioned(runs, path, ["bucket", "sub_bucket", "run_id"])


def run_document(members: DataFrame, overlap: DataFrame) -> DataFrame:
    """One row per run: totals and overlap statistics.  ``overlap`` has one row per run."""
    totals = members.groupBy("run_id").agg(
        F.countDistinct("cluster_id").alias("total_persons"),
        F.countDistinct("asset_id").alias("total_images"),
        F.count(F.lit(1)).alias("total_faces"),
        F.count_if(F.col("cluster_id").isNull()).alias("unassigned_faces"),
    )
    return totals.join(overlap, "run_id")


def cluster_pages(members: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Nested output: (run, cluster, page, members) with at most ``page_rows`` per page.

    Pages follow each other in the order of the members.  A member's page comes from its rank, which many
    tasks find, so that no cluster is ever gathered whole; together the pages hold every member, those
    without a cluster too.
    """
    keys, entry = ["run_id", "cluster_id"], ["detection_id", "asset_id", "confidence", "quality"]
    ranked = rank_within(members.select(*keys, *entry), keys, [F.asc(c) for c in entry], "_rank")
    page = F.floor((F.col("_rank") - 1) / page_rows).alias("page_no")
    return ranked.groupBy(*keys, page).agg(F.sort_array(F.collect_list(F.struct(*entry))).alias("members"))


def catalog_runs(
    runs: DataFrame, bucket: str | None = None, sub_bucket: str | None = None, run_id: str | None = None
) -> DataFrame:
    """Run count, totals and latest time per (bucket, sub-bucket), filtered."""
    kept = runs
    for name, value in (("bucket", bucket), ("sub_bucket", sub_bucket), ("run_id", run_id)):
        if value is not None:
            kept = kept.where(F.col(name) == value)
    return kept.groupBy("bucket", "sub_bucket").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("total_faces").alias("total_faces"),
        F.max("ts").alias("latest"),
    )


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """Up to ``k`` newest runs of every (bucket, sub-bucket)."""
    return first_per(runs, ["bucket", "sub_bucket"], [F.desc("ts"), F.asc("run_id")], k, "recency")


def inspect_table(table: DataFrame, vector: str = "owner_embedding") -> DataFrame:
    """One row: rows, fields, vector length and whether clusters can be assigned from it."""
    has_vector = vector in table.columns
    length = F.max(F.size(vector)) if has_vector else F.lit(None)
    return table.agg(
        F.count(F.lit(1)).alias("row_count"), length.cast("long").alias("embedding_length")
    ).select(
        "row_count",
        F.lit(len(table.columns)).cast("long").alias("n_fields"),
        F.lit(",".join(sorted(table.columns))).alias("fields"),
        F.lit(has_vector).alias("has_owner_embedding"),
        "embedding_length",
        ((F.col("row_count") > 0) & F.lit(has_vector)).alias("ready_for_assignment"),
    )


def drop_bad_ids(table: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is missing, not a 24-digit hexadecimal id, or a field name."""
    k = F.col(key).cast("string")
    return table.where(k.isNotNull() & ~k.isin("_id", "id") & k.rlike("^[0-9a-fA-F]{24}$"))


# Every field that a cluster entry may carry, whatever the layout of its document.
CLUSTER_FIELDS = T.StructType(
    [
        T.StructField("person_id", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("owner_face_id", T.StringType()),
        T.StructField("owner_embedding", T.ArrayType(T.DoubleType())),
        T.StructField("image_paths", T.ArrayType(T.StringType())),
        T.StructField("face_ids", T.ArrayType(T.StringType())),
        T.StructField("face_positions", T.ArrayType(T.StringType())),
        T.StructField("confidence_scores", T.ArrayType(T.DoubleType())),
        T.StructField("quality_scores", T.ArrayType(T.DoubleType())),
        T.StructField("size", T.LongType()),
        T.StructField("face_count", T.LongType()),
        T.StructField("count", T.LongType()),
        T.StructField("num_faces", T.LongType()),
        T.StructField("faces_count", T.LongType()),
        T.StructField("avg_confidence", T.DoubleType()),
    ]
)
NOT_CLUSTERS = ("_id", "unassigned_faces", "unassigned_face_ids")


def extract_clusters(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, layout, cluster) rows from JSON documents of five layouts.

    In order: a list or numbered map under ``person_clusters``; a list under
    ``clusters``; a list at the root; numbered keys at the root; else the first field
    that is a list whose first entry looks like a cluster.  Numbered keys stop at the
    first gap.  A document without clusters has one row of layout ``none``.
    """
    j = F.col(text)
    fields = F.from_json(j, "map<string,string>")
    docs = documents.select(key, j.alias("_j"), fields.alias("_m"))
    m = F.col("_m")
    persons, plain = F.get(F.array(m["person_clusters"]), F.lit(0)), m["clusters"]

    def is_list(c):
        return F.coalesce(F.ltrim(c).startswith("["), F.lit(False))

    def items(c):
        return F.from_json(c, "array<string>")

    def numbered(c):
        entries = F.map_entries(F.from_json(c, "map<string,string>"))
        plain = F.filter(entries, lambda e: e["key"].rlike("^(0|[1-9][0-9]{0,8})$") & e["value"].isNotNull())
        placed = F.transform(plain, lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))
        upto = F.filter(F.array_sort(placed), lambda e, i: e["k"] == i)  # up to the first gap
        return F.transform(upto, lambda e: e["v"])

    has_persons = F.coalesce(F.map_contains_key(m, "person_clusters"), F.lit(False))
    has_plain = F.coalesce(F.map_contains_key(m, "clusters"), F.lit(False))
    root_numbered = F.coalesce(F.map_contains_key(m, "0"), F.lit(False))

    def looks_like_cluster(e):
        first = F.get(items(e["value"]), F.lit(0))
        names = F.map_keys(F.from_json(first, "map<string,string>"))
        marks = F.array(F.lit("owner_embedding"), F.lit("cluster_id"), F.lit("face_positions"))
        return (
            ~e["key"].isin(*NOT_CLUSTERS) & is_list(e["value"])
            & F.coalesce(F.ltrim(first).startswith("{"), F.lit(False))
            & F.coalesce(F.arrays_overlap(names, marks), F.lit(False))
        )

    searched = F.get(F.filter(F.map_entries(m), looks_like_cluster), F.lit(0))
    layout = (
        F.when(is_list(F.col("_j")), "root_list")
        .when(has_persons, F.when(is_list(persons), "person_list").otherwise("person_map"))
        .when(has_plain, "clusters_list")
        .when(root_numbered, "root_map")
        .otherwise("searched_field")
    )
    entries = (
        F.when(F.col("layout") == "root_list", items(F.col("_j")))
        .when(F.col("layout") == "person_list", items(persons))
        .when(F.col("layout") == "person_map", numbered(persons))
        .when(F.col("layout") == "clusters_list", F.when(is_list(plain), items(plain)))
        .when(F.col("layout") == "root_map", numbered(F.col("_j")))
        .otherwise(items(searched["value"]))
    )
    found = docs.withColumn("layout", layout).withColumn("_entries", entries)
    rows = found.select(key, "layout", F.posexplode_outer("_entries").alias("position", "_c"))
    known = F.when(F.col("position").isNull(), "none").otherwise(F.col("layout"))
    return rows.select(
        key, known.alias("layout"), F.col("position").cast("long").alias("position"),
        F.from_json("_c", CLUSTER_FIELDS).alias("cluster"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
