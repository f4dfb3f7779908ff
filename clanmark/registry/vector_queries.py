"""Vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clanmark.functions import vectors as V
from clanmark.operators.filters import left_out
from clanmark.operators.similarity import similarity_self_join
from clanmark.registry import inputs as I
from clanmark.registry.base import checksum, checksum_sql, query
from clanmark.registry.sqltext import define, mean_of, unit

define(
    "near",
    """SELECT a.detection_id, a.vector AS va, b.vector AS vb, a.unit AS ua, b.unit AS ub
FROM det a JOIN det b ON b.detection_id = a.detection_id + 1""",
)


def near(spark, d):
    """Every detection with the next one."""
    det = I.detections(spark, d)
    a = det.select("detection_id", F.col("vector").alias("va"), F.col("unit").alias("ua"))
    b = det.select((F.col("detection_id") - 1).alias("detection_id"), F.col("vector").alias("vb"), F.col("unit").alias("ub"))
    return a.join(b, "detection_id")


@query(
    "l2_normalize",
    f"SELECT i AS vec_id, {checksum_sql('u')} AS weighted FROM (SELECT i, {unit('v')} AS u FROM e)",
)
def l2_normalize(spark, d):
    e = I.embeddings(spark, d).withColumn("u", V.l2_normalize("vector"))
    return e.select("vec_id", checksum("u").alias("weighted"))


@query(
    "cosine_similarity",
    "SELECT detection_id, round(list_cosine_similarity(va, vb), 6) AS similarity FROM near",
)
def cosine_similarity(spark, d):
    return near(spark, d).select("detection_id", V.cosine_similarity("va", "vb").alias("similarity"))


@query(
    "cosine_distance_abs",
    "SELECT detection_id, round(1 - abs(list_cosine_similarity(va, vb)), 6) AS distance FROM near",
)
def cosine_distance_abs(spark, d):
    return near(spark, d).select("detection_id", V.cosine_distance_abs("va", "vb").alias("distance"))


@query(
    "cosine_distance_xy",
    """SELECT detection_id, round(1 - list_inner_product(va, vb)
 / ((sqrt(list_inner_product(va, va)) + 1e-12) * (sqrt(list_inner_product(vb, vb)) + 1e-12)), 6) AS distance FROM near""",
)
def cosine_distance_xy(spark, d):
    return near(spark, d).select("detection_id", V.cosine_distance_xy("va", "vb").alias("distance"))


@query(
    "clipped_distance",
    """SELECT detection_id, round(least(greatest(1 - list_cosine_similarity(va, vb), 0::DOUBLE), 2::DOUBLE), 6) AS distance
FROM near""",
)
def clipped_distance(spark, d):
    similarity = V.cosine_similarity("va", "vb").alias("s")
    return near(spark, d).select("detection_id", similarity).select(
        "detection_id", V.clipped_distance("s").alias("distance")
    )


@query(
    "euclidean_distance",
    "SELECT detection_id, round(list_distance(ua, ub), 6) AS distance FROM near",
)
def euclidean_distance(spark, d):
    return near(spark, d).select("detection_id", V.euclidean_distance("ua", "ub").alias("distance"))


@query(
    "vector_mean",
    f"""SELECT label::BIGINT AS label, n AS size, k AS pos, round(c[k], 6) AS value
FROM (SELECT label, count(*) AS n, {mean_of('v')} AS c FROM e GROUP BY label), range(1, 65) t(k)""",
)
def vector_mean(spark, d):
    means = V.mean_vectors(I.embeddings(spark, d), ["label"], "vector")
    exploded = means.select("label", "size", F.posexplode("centroid").alias("p", "value"))
    return exploded.select("label", "size", (F.col("p") + 1).alias("pos"), "value")


@query(
    "unit_centroid",
    f"""SELECT label::BIGINT AS label, k AS pos, round(u[k], 6) AS value
FROM (SELECT label, {unit('c')} AS u FROM (SELECT label, {mean_of('v')} AS c FROM e GROUP BY label)), range(1, 65) t(k)""",
)
def unit_centroid(spark, d):
    means = V.unit_centroids(I.embeddings(spark, d), ["label"], "vector")
    exploded = means.select("label", F.posexplode("centroid").alias("p", "value"))
    return exploded.select("label", (F.col("p") + 1).alias("pos"), "value")


@query(
    "vector_mean_wide",
    f"""SELECT label::BIGINT AS label, n AS size, k AS pos, round(c[(k - 1) % 64 + 1] * ((k - 1) // 64 + 1), 6) AS value
FROM (SELECT label, count(*) AS n, {mean_of('v')} AS c FROM e GROUP BY label), range(1, 1025) t(k)""",
)
def vector_mean_wide(spark, d):
    """Means of vectors of 1 024 elements, the longest a profile may have: 16 multiples of each embedding."""
    wide = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda n: F.transform("vector", lambda x: x * n)))
    means = V.mean_vectors(I.embeddings(spark, d).withColumn("vector", wide), ["label"], "vector", 1024)
    exploded = means.select("label", "size", F.posexplode("centroid").alias("p", "value"))
    return exploded.select("label", "size", (F.col("p") + 1).alias("pos"), "value")


define(
    "ragged_e",
    """SELECT i, label, CASE WHEN len(v) = 64 THEN v END AS v FROM (SELECT i, label,
 CASE i % 17 WHEN 0 THEN []::DOUBLE[] WHEN 1 THEN v[1:10] WHEN 2 THEN list_concat(v, v) ELSE v END AS v FROM e)""",
)


def ragged(spark, d):
    """Embeddings of which some are empty, short or twice as long."""
    kind, v = F.col("vec_id") % 17, F.col("vector")
    odd = F.when(kind == 0, F.slice(v, 1, 0)).when(kind == 1, F.slice(v, 1, 10)).when(kind == 2, F.concat(v, v)).otherwise(v)
    return I.embeddings(spark, d).withColumn("vector", odd)


@query(
    "vector_mean_ragged",
    f"""SELECT label::BIGINT AS label, n AS size, k AS pos, round(c[k], 6) AS value
FROM (SELECT label, count(*) AS n, {mean_of('v')} AS c FROM ragged_e GROUP BY label), range(1, 65) t(k)""",
)
def vector_mean_ragged(spark, d):
    means = V.mean_vectors(ragged(spark, d), ["label"], "vector")
    exploded = means.select("label", "size", F.posexplode("centroid").alias("p", "value"))
    return exploded.select("label", "size", (F.col("p") + 1).alias("pos"), "value")


@query(
    "left_out",
    """SELECT CASE WHEN i % 29 = 0 THEN 'null' WHEN i % 17 = 0 THEN 'empty' WHEN i % 17 IN (1, 2) THEN 'other_length'
 WHEN i % 19 = 0 THEN 'not_finite' WHEN i % 23 = 0 THEN 'zero' ELSE 'usable' END AS reason, count(*) AS rows FROM e GROUP BY 1""",
)
def left_out_rows(spark, d):
    """Ragged vectors, some of them null, zero or with an infinite element."""
    i, v = F.col("vec_id"), F.col("vector")
    odd = F.when(i % 19 == 0, F.transform(v, lambda x: x * F.lit(float("inf"))))
    odd = odd.when(i % 23 == 0, F.transform(v, lambda x: x * 0.0)).otherwise(v)
    spoiled = ragged(spark, d).withColumn("vector", F.when(i % 29 > 0, odd))
    return left_out(spoiled, "vector")


@query(
    "similarity_self_join_ragged",
    """SELECT a.i AS a, b.i AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
FROM ragged_e a JOIN ragged_e b ON a.i < b.i WHERE list_cosine_similarity(a.v, b.v) >= 0.3""",
)
def similarity_self_join_ragged(spark, d):
    return similarity_self_join(ragged(spark, d), "vec_id", "vector", 0.3)


@query(
    "vector_standardize",
    f"""SELECT i AS vec_id, {checksum_sql('z')} AS weighted FROM (
 SELECT i, list_transform(c, lambda q: q / greatest(sqrt(list_inner_product(c, c) / len(c)), 1 / sqrt(len(c)))) AS z
 FROM (SELECT i, list_transform(v, lambda q: q - m) AS c FROM (SELECT i, v, list_avg(v) AS m FROM e)))""",
)
def vector_standardize(spark, d):
    e = I.embeddings(spark, d).withColumn("z", V.standardize("vector"))
    return e.select("vec_id", checksum("z").alias("weighted"))


@query(
    "mean_of_variants",
    f"""SELECT item, n AS n_vectors, {checksum_sql('c')} AS weighted FROM (
 SELECT i // 6 AS item, count(*) AS n, {mean_of('v')} AS c, count(*) FILTER (i % 6 = 0) AS base FROM e
 WHERE i % 7 <> 3 GROUP BY i // 6) WHERE base > 0""",
)
def mean_of_variants(spark, d):
    i = F.col("vec_id")
    rows = I.embeddings(spark, d).select(
        F.expr("vec_id div 6").alias("item"),
        F.when(i % 6 > 0, i % 6 - 1).alias("variant"),
        F.when(i % 7 != 3, F.col("vector")).alias("vector"),
    )
    means = V.mean_of_variants(rows, "item", "variant", "vector", dim=64)
    return means.select("item", "n_vectors", checksum("centroid").alias("weighted"))
