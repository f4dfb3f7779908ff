"""Assignment of clusters to profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.operators import assign as O
from clanmark.operators.components import similarity_components
from clanmark.plans import entities as E
from clanmark.registry import inputs as I
from clanmark.registry.base import checksum, checksum_sql, query
from clanmark.registry.sqltext import define, mean_of, unit


def at(text: str):
    return F.lit(text).cast("timestamp")


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "load_profiles",
    f"""SELECT user_id, {checksum_sql('u')} AS weighted FROM (SELECT user_id, {unit('embedding')} AS u FROM submitted WHERE len(embedding) > 0)""",
)
def load_profiles(spark, d):
    loaded = O.load_profiles(I.submitted_profiles(spark, d))
    return loaded.select("user_id", checksum("unit").alias("weighted"))


@query(
    "assign_clusters",
    """SELECT run_id, cluster_id, user_id, round(similarity, 4) AS similarity, strategy FROM assignments""",
)
def assign_clusters(spark, d):
    clusters = I.clusters(spark, d)
    known = O.load_profiles(I.profiles(spark, d))
    found = O.assign_clusters(clusters.select("cluster_key", "owner_unit"), known)
    named = found.join(clusters.select("cluster_key", "run_id", "cluster_id"), "cluster_key")
    return named.select("run_id", "cluster_id", "user_id", F.round("similarity", 4).alias("similarity"), "strategy")


define("mem75", "SELECT d.detection_id, d.unit, c.component AS cluster_id FROM det d JOIN comp75 c ON c.id = d.detection_id")
define(
    "cent75",
    f"SELECT cluster_id, {unit('c')} AS u FROM (SELECT cluster_id, {mean_of('unit')} AS c FROM mem75 GROUP BY cluster_id)",
)
define(
    "votes",
    """SELECT cluster_id, user_id, count(*) AS votes, avg(s) AS similarity FROM (SELECT detection_id, user_id, s,
  row_number() OVER (PARTITION BY detection_id ORDER BY round(s, 12) DESC, user_id) AS n FROM cross_pair)
 JOIN mem75 USING (detection_id) WHERE n = 1 AND s >= 0.65 GROUP BY ALL""",
)


def members75(spark, d):
    det = I.detections(spark, d)
    parts = similarity_components(det, "detection_id", "unit", 0.75)
    return det.select("detection_id", "unit").join(parts, "detection_id").withColumnRenamed("component", "cluster_id")


@query(
    "assign_by_centroid",
    """SELECT cluster_id, user_id, round(s, 6) AS similarity FROM (SELECT cluster_id, user_id, s,
  row_number() OVER (PARTITION BY cluster_id ORDER BY round(s, 12) DESC, user_id) AS n
  FROM (SELECT cluster_id, user_id, list_cosine_similarity(u, embedding) AS s FROM cent75, profiles)) WHERE n = 1 AND s >= 0.65""",
)
def assign_by_centroid(spark, d):
    known = O.load_profiles(I.profiles(spark, d))
    return O.assign_by_centroid(members75(spark, d), known, "cluster_id", "unit").drop("strategy")


@query(
    "assign_by_vote",
    """SELECT cluster_id, user_id, votes, round(similarity, 6) AS similarity FROM (SELECT *,
  row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, round(similarity, 12) DESC, user_id) AS n FROM votes) WHERE n = 1""",
)
def assign_by_vote(spark, d):
    known = O.load_profiles(I.profiles(spark, d))
    return O.assign_by_vote(members75(spark, d), known, "cluster_id", "detection_id", "unit").drop("strategy")


@query(
    "positional_cluster_ids",
    """SELECT run_id, cluster_id AS key, 'cluster_' || (row_number() OVER (PARTITION BY run_id ORDER BY cluster_id) - 1) AS cluster_id FROM clusters""",
)
def positional_cluster_ids(spark, d):
    keys = I.clusters(spark, d).select("run_id", F.col("cluster_id").alias("key"))
    return O.positional_cluster_ids(keys, [F.asc("key")])


define(
    "ragged",
    """SELECT detection_id, CASE WHEN detection_id % 4 = 0 THEN detection_id % 6 END AS size,
 CASE WHEN detection_id % 4 = 1 THEN 3 END AS face_count, CASE WHEN detection_id % 4 = 2 THEN 9 END AS num_faces,
 list_transform(range(detection_id % 6), lambda k: 'p' || k) AS paths,
 list_transform(range(detection_id % 5), lambda k: 'f' || k) AS faces FROM det""",
)


def ragged(spark, d):
    i = F.col("detection_id")

    def named(prefix: str, n):
        steps = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda k: F.concat(F.lit(prefix), k.cast("string")))

    return I.detections(spark, d).select(
        "detection_id",
        F.when(i % 4 == 0, i % 6).alias("size"),
        F.when(i % 4 == 1, F.lit(3)).alias("face_count"),
        F.when(i % 4 == 2, F.lit(9)).alias("num_faces"),
        named("p", i % 6).alias("paths"),
        named("f", i % 5).alias("faces"),
    )


@query(
    "resolve_face_count",
    """SELECT detection_id, CASE WHEN len(paths) = stated AND len(faces) = stated THEN stated
  ELSE greatest(len(paths), len(faces)) END AS face_count FROM (SELECT *,
 coalesce(size, face_count, num_faces, greatest(len(paths), len(faces))) AS stated FROM ragged)""",
)
def resolve_face_count(spark, d):
    made = O.resolve_face_count(
        F.col("size"), [F.col("face_count"), F.col("num_faces")], F.col("paths"), F.col("faces")
    )
    return ragged(spark, d).select("detection_id", made.alias("face_count"))


@query(
    "align_arrays",
    """SELECT detection_id, array_to_string(list_concat(paths, list_transform(range(len(paths), greatest(len(paths), len(faces))), lambda k: '')), ',') AS paths,
 array_to_string(list_concat(faces, list_transform(range(len(faces), greatest(len(paths), len(faces))), lambda k: 'unknown_face_' || k)), ',') AS faces
FROM ragged""",
)
def align_arrays(spark, d):
    paths, faces = O.align_arrays(F.col("paths"), F.col("faces"))
    return ragged(spark, d).select(
        "detection_id", F.array_join(paths, ",").alias("paths"), F.array_join(faces, ",").alias("faces")
    )


@query(
    "assign_all_runs",
    """SELECT run_id, count(*) AS total_clusters, count(a.user_id) AS assigned_clusters,
 count(*) - count(a.user_id) AS unassigned_clusters FROM clusters LEFT JOIN assignments a USING (run_id, cluster_id) GROUP BY run_id""",
)
def assign_all_runs(spark, d):
    return O.assignment_totals(I.clusters(spark, d), I.assignments(spark, d))


define(
    "fresh",
    """SELECT run_id, cluster_id + CASE WHEN cluster_id % 2 = 0 THEN 0 ELSE 1000000 END AS cluster_id, 'user_new' AS user_id,
 similarity / 2 AS similarity, 'vote' AS strategy, face_count, bucket_path FROM assignments WHERE run_id LIKE 'r1%'""",
)


def fresh(spark, d):
    """New rows for one clustering: even clusters again, odd ones under new ids."""
    moved = F.col("cluster_id") + F.when(F.col("cluster_id") % 2 == 0, 0).otherwise(1000000)
    return I.assignments(spark, d).where(F.col("run_id").startswith("r1")).select(
        "run_id", moved.alias("cluster_id"), F.lit("user_new").alias("user_id"),
        (F.col("similarity") / 2).alias("similarity"), F.lit("vote").alias("strategy"), "face_count", "bucket_path",
    )


FIELDS = "{t}run_id, {t}cluster_id, {t}user_id, round({t}similarity, 6) AS similarity, {t}strategy, {t}face_count, {t}bucket_path"
TIMES = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS created_at, strftime({u}, '%Y-%m-%d %H:%M:%S') AS updated_at"


@query(
    "assignment_upsert",
    f"""SELECT {FIELDS.format(t="a.")}, {TIMES.format(c="created_at", u="created_at")} FROM assignments a
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.run_id = a.run_id AND f.cluster_id = a.cluster_id)
UNION ALL SELECT {FIELDS.format(t="f.")},
 {TIMES.format(c="coalesce(a.created_at, TIMESTAMP '2024-03-01')", u="TIMESTAMP '2024-03-01'")}
FROM fresh f LEFT JOIN assignments a ON a.run_id = f.run_id AND a.cluster_id = f.cluster_id""",
)
def assignment_upsert(spark, d):
    merged = O.assignment_upsert(I.assignments(spark, d), fresh(spark, d), at("2024-03-01 00:00:00"))
    return merged.withColumns({c: stamp(c) for c in ("created_at", "updated_at")})


@query(
    "assignment_overwrite",
    f"""SELECT {FIELDS.format(t="")}, {TIMES.format(c="created_at", u="created_at")} FROM assignments WHERE run_id NOT IN (SELECT run_id FROM fresh)
UNION ALL SELECT {FIELDS.format(t="")}, {TIMES.format(c="TIMESTAMP '2024-03-01'", u="TIMESTAMP '2024-03-01'")} FROM fresh""",
)
def assignment_overwrite(spark, d):
    merged = O.assignment_upsert(
        I.assignments(spark, d), fresh(spark, d), at("2024-03-01 00:00:00"), overwrite=True
    )
    return merged.withColumns({c: stamp(c) for c in ("created_at", "updated_at")})


ALBUMS = """SELECT CASE WHEN s >= {t} THEN 'matched' ELSE 'anonymous' END AS kind, cluster_key, CASE WHEN s >= {t} THEN user_id END AS user_id,
 round(s, 6) AS similarity FROM (SELECT run_id || '/' || cluster_id AS cluster_key, user_id, s,
  row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY round(s, 12) DESC, user_id) AS n FROM scores) WHERE n = 1
UNION ALL SELECT CASE WHEN s >= 0.5 THEN 'matched_noise' ELSE 'noise' END, 'noise/' || run_id || '/' || detection_id, CASE WHEN s >= 0.5 THEN user_id END,
 round(s, 6) FROM (SELECT run_id, detection_id, user_id, s, row_number() OVER (PARTITION BY run_id, detection_id ORDER BY round(s, 12) DESC, user_id) AS n
  FROM members JOIN cross_pair USING (detection_id) WHERE cluster_id IS NULL) WHERE n = 1"""


@query("album_split", ALBUMS.format(t=0.7))
def album_split(spark, d, threshold=0.7):
    owners = I.clusters(spark, d).select("cluster_key", "owner_unit")
    noise = I.members(spark, d).where(F.col("cluster_id").isNull()).select(
        F.concat_ws("/", F.lit("noise"), "run_id", F.col("detection_id").cast("string")).alias("cluster_key"),
        F.col("unit").alias("owner_unit"),
    )
    known = O.load_profiles(I.profiles(spark, d))
    return O.album_split(owners, known, noise, "cluster_key", "owner_unit", threshold=threshold)


@query("album_split_default", ALBUMS.format(t=0.6))
def album_split_default(spark, d):
    return album_split(spark, d, 0.6)


@query(
    "assignments_by_run",
    "SELECT run_id, cluster_id, user_id, round(similarity, 6) AS similarity FROM assignments WHERE run_id = 'r1a'",
)
def assignments_by_run(spark, d):
    return O.assignments_by_run(I.assignments(spark, d), "r1a").select("run_id", "cluster_id", "user_id", "similarity")


@query(
    "assignments_by_user",
    """SELECT run_id, cluster_id, user_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM assignments
WHERE user_id = 'user_000000' ORDER BY created_at DESC""",
)
def assignments_by_user(spark, d):
    found = O.assignments_by_user(I.assignments(spark, d), "user_000000")
    return found.select("run_id", "cluster_id", "user_id", stamp("created_at"))


@query(
    "assignments_by_cluster",
    "SELECT run_id, cluster_id, user_id, face_count FROM assignments WHERE run_id = 'r1a' AND cluster_id = 0",
)
def assignments_by_cluster(spark, d):
    found = O.assignments_by_cluster(I.assignments(spark, d), "r1a", 0)
    return found.select("run_id", "cluster_id", "user_id", "face_count")


@query(
    "user_summary",
    """SELECT user_id, bucket_path, clusters, faces, (sum(clusters) OVER w)::BIGINT AS total_clusters, (sum(faces) OVER w)::BIGINT AS total_faces,
 round(sum(s) OVER w / sum(clusters) OVER w, 4) AS average_similarity
FROM (SELECT user_id, bucket_path, count(*) AS clusters, sum(face_count)::BIGINT AS faces, sum(similarity) AS s FROM assignments GROUP BY ALL)
WINDOW w AS (PARTITION BY user_id)""",
)
def user_summary(spark, d):
    return O.user_summary(I.assignments(spark, d))


@query(
    "user_assignments_grouped",
    """SELECT user_id, run_id, bucket_path, count(*) AS cluster_count, sum(face_count)::BIGINT AS total_faces,
 round(avg(similarity), 4) AS avg_similarity FROM assignments WHERE bucket_path LIKE 'photos/%' GROUP BY ALL""",
)
def user_assignments_grouped(spark, d):
    return O.user_assignments_grouped(I.assignments(spark, d), bucket="photos")


GROUPED = """SELECT '{name}' AS filter, user_id, run_id, bucket_path, count(*) AS cluster_count, sum(face_count)::BIGINT AS total_faces,
 round(avg(similarity), 4) AS avg_similarity FROM assignments WHERE {rows} GROUP BY ALL"""


@query(
    "user_assignments_filtered",
    " UNION ALL ".join([
        GROUPED.format(name="none", rows="TRUE"),
        GROUPED.format(name="run", rows="run_id = 'r1a'"),
        GROUPED.format(name="run_sub", rows="run_id = 'r2b' AND bucket_path LIKE '%/b'"),
        GROUPED.format(name="both", rows="bucket_path = 'photos/b'"),
        GROUPED.format(name="sub", rows="bucket_path LIKE '%/a'"),
    ]),
)
def user_assignments_filtered(spark, d):
    """By run, run and sub-bucket, bucket with sub-bucket, and sub-bucket alone."""
    table = I.assignments(spark, d)
    calls = {
        "none": {}, "run": {"run_id": "r1a"}, "run_sub": {"run_id": "r2b", "sub_bucket": "b"},
        "both": {"bucket": "photos", "sub_bucket": "b"}, "sub": {"sub_bucket": "a"},
    }
    whole = None
    for name, how in calls.items():
        part = O.user_assignments_grouped(table, **how).select(F.lit(name).alias("filter"), "*")
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(
    "assignment_dry_run",
    f"SELECT {FIELDS.format(t='')}, {TIMES.format(c='created_at', u='created_at')} FROM assignments",
)
def assignment_dry_run(spark, d):
    same = O.assignment_upsert(I.assignments(spark, d), fresh(spark, d), at("2024-03-01 00:00:00"), dry_run=True)
    return same.withColumns({c: stamp(c) for c in ("created_at", "updated_at")})


@query(
    "run_assignment_info",
    """SELECT run_id, count(*) AS total_assigned, count(DISTINCT user_id) AS total_users, round(avg(similarity), 6) AS avg_similarity
FROM assignments GROUP BY run_id""",
)
def run_assignment_info(spark, d):
    return O.run_assignment_info(I.assignments(spark, d))


define("kept_sym", "SELECT a, b FROM pair WHERE s >= 0.75 UNION ALL SELECT b, a FROM pair WHERE s >= 0.75")
define(
    "kept_lab",
    "SELECT detection_id, detection_id FROM det UNION SELECT s.b, l.c FROM kept_lab l JOIN kept_sym s ON s.a = l.id WHERE l.c < s.b",
    "(id, c)",
    materialized=False,
)
define(
    "kept",
    """SELECT t.*, c.cluster_id, quality * 0.6::DOUBLE + confidence * 0.4::DOUBLE AS score FROM det t
 JOIN (SELECT id, min(c) AS cluster_id FROM kept_lab GROUP BY id) c ON c.id = t.detection_id""",
)
define("kept_cent", f"SELECT cluster_id, {mean_of('unit')} AS c FROM kept GROUP BY cluster_id")


def entities_sql(name: str, threshold: str) -> str:
    """The flagship query: clusters after the merge pass, with owner and profile."""
    define(f"{name}_cand", f"""SELECT row_number() OVER (ORDER BY a, b) AS n, a, b FROM (SELECT x.cluster_id AS a, y.cluster_id AS b
 FROM kept_cent x JOIN kept_cent y ON x.cluster_id < y.cluster_id WHERE list_cosine_similarity(x.c, y.c) >= {threshold})""")
    define(
        f"{name}_scan",
        f"""SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT c.n, CASE WHEN list_contains(used, c.a) OR list_contains(used, c.b) THEN used ELSE list_concat(used, [c.a, c.b]) END,
 CASE WHEN NOT (list_contains(used, c.a) OR list_contains(used, c.b)) THEN c.a END,
 CASE WHEN NOT (list_contains(used, c.a) OR list_contains(used, c.b)) THEN c.b END
FROM {name}_scan s JOIN {name}_cand c ON c.n = s.n + 1""",
        "(n, used, a, b)",
        materialized=False,
    )
    return f"""SELECT cluster_id, count(*) AS total_detections, count(DISTINCT asset_id) AS unique_assets,
 round(avg(confidence), 6) AS avg_confidence, round(max(quality), 6) AS best_quality, min(detection_id) AS first_id,
 max(CASE WHEN r = 1 THEN detection_id END) AS owner_id, round(max(score), 6) AS owner_score, max(CASE WHEN r = 1 THEN asset_id END) AS owner_asset
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, detection_id) AS r FROM (
 SELECT k.* REPLACE (coalesce(s.a, k.cluster_id) AS cluster_id) FROM kept k LEFT JOIN {name}_scan s ON s.b = k.cluster_id)) GROUP BY cluster_id"""


@query("entities", entities_sql("strict_merge", "0.85"))
def entities(spark, d):
    return E.entities(I.detections(spark, d))


@query("entities_loose_merge", entities_sql("loose_merge", "0.6"))
def entities_loose_merge(spark, d):
    """A lower merge threshold, so that the merge pass has work at every scale."""
    return E.entities(I.detections(spark, d), merge_threshold=0.6)


@query(
    "link_users",
    f"""SELECT {FIELDS.format(t="")}, {TIMES.format(
    c="CASE WHEN run_id LIKE 'r1%' THEN created_at ELSE TIMESTAMP '2024-03-01' END", u="TIMESTAMP '2024-03-01'")} FROM assignments""",
)
def link_users(spark, d):
    """All runs at once over a table that holds one clustering with other values."""
    place = F.concat(F.lit("photos/"), F.substring("run_id", 3, 1))
    clusters = I.clusters(spark, d).withColumn("bucket_path", place)
    known = I.assignments(spark, d).where(F.col("run_id").startswith("r1")).withColumn("user_id", F.lit("before"))
    linked = E.link_users(clusters, I.profiles(spark, d), known, at("2024-03-01 00:00:00"))
    return linked.withColumns({c: stamp(c) for c in ("created_at", "updated_at")})
