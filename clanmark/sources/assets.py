"""Asset listings and batch layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clanmark.functions import paths as P
from clanmark.operators.numbering import number_rows

PIPELINE_BYTES = 20 * 1024 * 1024
ENHANCED_BYTES = 15 * 1024 * 1024
DECODE_BYTES = 10_000_000


def read_assets(spark: SparkSession, folder: str) -> DataFrame:
    """(key, length, modified) of every file under ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), "length", F.col("modificationTime").alias("modified"))


def list_assets(
    keys: DataFrame,
    prefix: str,
    max_n: int | None = None,
    key: str = "key",
    extensions: tuple[str, ...] = P.IMAGE_EXTENSIONS,
) -> DataFrame:
    """Image keys under ``prefix``; the first ``max_n`` in lexicographic order if given."""
    k = F.col(key)
    kept = keys.where(
        k.startswith(prefix) & P.has_extension(k, extensions) & ~k.endswith("/") & (k != prefix)
    )
    return kept.orderBy(key).limit(max_n) if max_n else kept


def size_guard(files: DataFrame, limit: int = PIPELINE_BYTES, length: str = "length") -> DataFrame:
    return files.where(F.col(length) <= limit)


def number_batch(files: DataFrame, batch: str, order: list[Column]) -> DataFrame:
    """``organized_path``: ``image_0001.jpg`` … under the batch path, in ``order``."""
    numbered = number_rows(files, order, "position", start=1)
    name = F.format_string("image_%04d.jpg", F.col("position"))
    return numbered.withColumn("organized_path", F.concat_ws("/", P.anonymous_path(F.lit(batch)), name))


def organize_profiles(files: DataFrame, user_id: str, path: str) -> DataFrame:
    """Profile keys of the rows with a valid id."""
    u = F.col(user_id)
    return files.where(P.valid_path_id(u)).select(
        user_id,
        F.col(path).alias("original_path"),
        P.profile_image_key(u).alias("profile_key"),
        P.profile_path(u).alias("profile_path"),
    )


def sequential_user_ids(rows: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` plus ``user_id``: numbers that follow the highest existing ``user_NNNNNN``."""
    number = F.regexp_extract("user_id", r"^user_(\d+)$", 1)
    highest = existing.agg(F.max(F.nullif(number, F.lit("")).cast("long")).alias("m")).first()["m"] or 0
    numbered = number_rows(rows, order, "_n", start=highest + 1)
    return numbered.withColumn("user_id", P.sequential_user_id(F.col("_n"))).drop("_n")
