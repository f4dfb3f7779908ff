"""Stored tables that change and answer by key without being read or written whole.

A keyed table is Parquet, partitioned by plain columns (a run, a bucket) and then by a hash bucket of its key.
Inside a bucket rows are sorted by the key, with a Bloom filter on it.  So

* a change reads and replaces only the partitions that hold one of its keys;
* a lookup opens only the buckets of its keys, and in them the row groups that may hold one;
* a run is dropped by deleting its folders, and counted from the footers of its files.

The number of buckets is part of the name of the bucket column, so the table describes itself.  One writer at a
time may change a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clanmark.operators import assign, maintain
from clanmark.sources.workspace import materialize, release

BUCKETS = 64
#: Keys that a lookup hands to the scan as values; more of them are joined.
LISTED_KEYS = 1000
#: Bytes of a row group: small ones, so that a lookup reads little.
ROW_GROUP = 8 << 20

BUCKET_NAME = re.compile(r"bucket_of_(\d+)$")


@dataclass(frozen=True)
class KeyedTable:
    """A stored table: where it is, its key, the plain columns it is partitioned by, and its buckets.

    With a schema, plain columns keep their types; without one Spark guesses them from the folder names.
    """

    path: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    buckets: int = BUCKETS
    schema: T.StructType | None = None

    @property
    def bucket(self) -> str:
        return f"bucket_of_{self.buckets}"

    @property
    def places(self) -> list[str]:
        return [*self.by, self.bucket]

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the bucket of every row's key."""
        return df.withColumn(self.bucket, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _write(df: DataFrame, table: KeyedTable, mode: str) -> None:
    """Partitions of ``df`` written or replaced; a few sorted files each."""
    ordered = table.placed(df).hint("rebalance", *table.places).sortWithinPartitions(*table.places, *table.keys)
    writer = ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.block.size", str(ROW_GROUP))
    for key in table.keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.partitionBy(*table.places).parquet(table.path)


def create(df: DataFrame, table: KeyedTable) -> KeyedTable:
    """Store ``df`` as a new keyed table; returns it with its schema."""
    _write(df, table, "errorifexists")
    return replace(table, schema=table.placed(df.limit(0)).schema)


def stored(spark: SparkSession, path: str, keys: tuple[str, ...]) -> KeyedTable:
    """The table of a path, as its folders describe it."""
    fields = spark.read.parquet(path).schema.names
    name = next(f for f in reversed(fields) if BUCKET_NAME.match(f))
    fs, target = _fs(spark, path)
    by, folder = [], target
    while True:
        inside = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        if not inside:
            break
        by.append(inside[0].getName().split("=", 1)[0])
        folder = inside[0]
    return KeyedTable(path, keys, tuple(c for c in by if c != name), int(BUCKET_NAME.match(name).group(1)))


def _whole(spark: SparkSession, table: KeyedTable) -> DataFrame:
    reader = spark.read if table.schema is None else spark.read.schema(table.schema)
    return reader.parquet(table.path)


def rows(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """All rows, without the bucket."""
    return _whole(spark, table).drop(table.bucket)


def _any_of(places: list[tuple], names: list[str]) -> Column:
    """A condition on partition columns that Spark evaluates on folder names."""
    condition = F.lit(False)
    grouped: dict[tuple, list] = {}
    for place in places:
        grouped.setdefault(place[:-1], []).append(place[-1])
    for front, last in grouped.items():
        same = F.col(names[-1]).isin(last)
        for name, value in zip(names, front):
            same = same & F.col(name).eqNullSafe(F.lit(value))
        condition = condition | same
    return condition


def _places(df: DataFrame, names: list[str]) -> list[tuple]:
    """Distinct partitions of some rows: as many as folders, never as many as rows."""
    return [tuple(r) for r in df.select(*names).distinct().collect()]


def change(
    spark: SparkSession, table: KeyedTable, patch: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame],
    adds: bool = True, on: Column | None = None,
) -> list[tuple]:
    """Replace the partitions that hold a key of ``patch`` by ``apply(their rows, patch)``; returns them.

    ``patch`` has the key columns, and the plain partition columns if it may add rows (``adds``).  ``on``
    narrows the partitions by their plain columns.  Rows that ``apply`` moves to other plain columns keep their
    bucket; what they move to is read and replaced as well.  The new rows are written to the work
    folder before anything is replaced, and a partition left without rows is deleted.
    """
    whole = _whole(spark, table)
    patch = materialize(patch, "patch")
    placed = table.placed(patch)
    buckets = _places(placed, [table.bucket])
    near = whole.where(_any_of(buckets, [table.bucket])) if on is None else whole.where(_any_of(buckets, [table.bucket]) & on)
    touched = set(_places(near.join(placed.select(*table.keys), list(table.keys), "left_semi"), table.places))
    if adds:
        touched |= set(_places(placed, table.places))
    after: set[tuple] = set()
    while True:  # once more if rows move to partitions that were not read
        current = whole.where(_any_of(sorted(touched, key=str), table.places)) if touched else whole.limit(0)
        result = materialize(apply(current.drop(table.bucket), patch), "changed")
        after = set(_places(table.placed(result), table.places))
        if after <= touched:
            break
        touched |= after
        release(result)
    if after:
        _write(result, table, "overwrite")
    _delete_folders(spark, table, [p for p in touched if p not in after])
    release(patch, result)
    return sorted(touched, key=str)


def _delete_folders(spark: SparkSession, table: KeyedTable, places: list[tuple]) -> None:
    for place in places:
        steps = []
        for name, value in zip(table.places, place):
            text = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
            steps.append(f"{name}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(text)}")
        fs, target = _fs(spark, "/".join([table.path, *steps]))
        fs.delete(target, True)


def upsert_profiles(spark: SparkSession, table: KeyedTable, new: DataFrame, at: Column, order: str) -> list[tuple]:
    """``maintain.upsert_profile`` on the buckets of the new rows' users."""
    key = table.keys[0]
    return change(spark, table, new, lambda current, patch: maintain.upsert_profile(current, patch, at, order, key))


def upsert_assignments(spark: SparkSession, table: KeyedTable, new: DataFrame, at: Column, dry_run: bool = False) -> list[tuple]:
    """``assign.assignment_upsert`` on the partitions of the new rows' (run, cluster)."""
    if dry_run:
        return []
    return change(spark, table, new, lambda current, patch: assign.assignment_upsert(current, patch, at))


def reassign(spark: SparkSession, table: KeyedTable, patch: DataFrame, run_id: str, person: Column | str) -> list[tuple]:
    """``maintain.reassign_members`` on the listed detections' buckets of one run."""
    def apply(current: DataFrame, own: DataFrame) -> DataFrame:
        return maintain.reassign_members(current, own, run_id, person, table.keys[0])

    return change(spark, table, patch, apply, adds=False, on=F.col("run_id") == run_id)


def relabel(spark: SparkSession, table: KeyedTable, patch: DataFrame) -> list[tuple]:
    """``maintain.relabel_members`` on the listed detections' buckets."""
    return change(spark, table, patch, lambda current, own: maintain.relabel_members(current, own, table.keys[0]), adds=False)


def stamp_run(spark: SparkSession, table: KeyedTable, ids: DataFrame, run_id: str) -> list[tuple]:
    """``maintain.stamp_run_id`` on the listed detections' buckets; the rows move to the run's folders."""
    return change(spark, table, ids, lambda current, own: maintain.stamp_run_id(current, own, run_id, table.keys[0]), adds=False)


def delete_keys(spark: SparkSession, table: KeyedTable, keys: DataFrame) -> list[tuple]:
    """Delete by key table."""
    on = list(table.keys)
    return change(spark, table, keys.select(*on), lambda current, own: maintain.without_keys(current, own, on), adds=False)


def lookup(spark: SparkSession, table: KeyedTable, keys: DataFrame) -> DataFrame:
    """The rows of the keys: only their buckets are opened.

    Up to ``LISTED_KEYS`` distinct keys go to the scan as values, where row group statistics and
    Bloom filters skip what cannot hold one; more are joined inside their buckets.
    """
    wanted = materialize(table.placed(keys.select(*table.keys).distinct()), "keys")
    buckets = _places(wanted, [table.bucket])
    near = _whole(spark, table).where(_any_of(buckets, [table.bucket]))
    few = wanted.limit(LISTED_KEYS + 1).collect()
    if len(few) > LISTED_KEYS:
        return near.join(wanted.select(*table.keys), list(table.keys), "left_semi").drop(table.bucket)
    release(wanted)
    for key in table.keys:
        near = near.where(F.col(key).isin([r[key] for r in few]))
    if len(table.keys) > 1:
        same = F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in table.keys]) for r in few]) if few else None
        near = near.where(F.array_contains(same, F.struct(*table.keys))) if few else near.limit(0)
    return near.drop(table.bucket)


# ---------------------------------------------------------------- footers


def footers(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet scans answer count, min and max from file footers."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        value = spark.conf.get(name, None)
        if value is not None and session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def counted(spark: SparkSession, table: KeyedTable, **where: str) -> DataFrame:
    """(rows): how many rows the partitions of some plain columns hold, from file footers alone."""
    df = _whole(footers(spark), table)
    for name, value in where.items():
        df = df.where(F.col(name) == value)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.greatest("rows", F.lit(0)).alias("rows"))  # no file: no count


def inspect(spark: SparkSession, table: KeyedTable, vector: str = "owner_embedding", length: str = "dims") -> DataFrame:
    """``tables.inspect_table`` from footers: the vector's length is the maximum of a column stored beside it.

    ``with_length`` adds that column when the table is written; no vector is read.
    """
    df = _whole(footers(spark), table)
    names = [c for c in df.columns if c not in (table.bucket, length)]
    has = vector in names and length in df.columns
    facts = df.agg(F.count(F.lit(1)).alias("row_count"), *([F.max(length).alias("l")] if has else []))
    longest = F.col("l") if has else F.lit(None)
    facts = facts.withColumn("row_count", F.greatest("row_count", F.lit(0)))
    return facts.select(
        "row_count", F.lit(len(names)).cast("long").alias("n_fields"), F.lit(",".join(sorted(names))).alias("fields"),
        F.lit(vector in names).alias("has_owner_embedding"), longest.cast("long").alias("embedding_length"),
        ((F.col("row_count") > 0) & F.lit(vector in names)).alias("ready_for_assignment"),
    )


def with_length(df: DataFrame, vector: str, length: str = "dims") -> DataFrame:
    """``df`` with the length of its vectors as a column whose maximum stands in the footers."""
    return df.withColumn(length, F.size(vector))


def drop_where(spark: SparkSession, table: KeyedTable, dry_run: bool = False, **where: str) -> int:
    """Delete the folders of some plain columns' values; returns the number of rows they hold, from footers."""
    wrong = set(where) - set(table.by)
    if wrong or not where:
        raise ValueError(f"not partitioned by {sorted(wrong)}" if wrong else "name at least one partition column")
    n = counted(spark, table, **where).first()["rows"]
    if n and not dry_run:
        keep = F.lit(True)
        for name, value in where.items():
            keep = keep & (F.col(name) == value)
        _delete_folders(spark, table, _places(_whole(spark, table).where(keep), table.places))
    return n


def cleanup_run(spark: SparkSession, assignments: KeyedTable, points: KeyedTable, run_id: str, dry_run: bool = False) -> DataFrame:
    """The report of ``maintain.cleanup_run`` for stored tables: folders go, no row is read."""
    report = []
    for name, table in (("assignments", assignments), ("vectors", points)):
        n = drop_where(spark, table, dry_run, run_id=run_id)
        report.append((name, n, 0 if dry_run else n, True))
    return spark.createDataFrame(report, "step string, found long, deleted long, success boolean")
