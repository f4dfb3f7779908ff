"""K-d tree sharding: a corpus cut at weighted medians of its metadata into shards of equal bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.llm.base import col
from clanmark.operators.numbering import running_sum
from clanmark.sources.workspace import materialize, release

#: A cut may miss its share by this part of a shard before a heavy group is set aside.
TOLERANCE = 0.001
DIMENSIONS = ("lang", "source", "n_chars")


def _coordinate(df: DataFrame, name: str) -> Column:
    """A metadata column as a DOUBLE: the logarithm of numbers, a hash into [0, 1) of anything else."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.log1p(F.abs(col(name).cast("double")))
    else:
        value = F.pmod(F.xxhash64(col(name).cast("string")), F.lit(1 << 20)).cast("double") / (1 << 20)
    return F.coalesce(F.when(F.isnan(value), -1.0).otherwise(value), F.lit(-1.0))


def _rows(docs: DataFrame, text: str, doc_id: str, dimensions: list[str]) -> DataFrame:
    """The narrow rows that the tree works on; texts are read once."""
    content = F.coalesce(col(text), F.lit(""))
    rows = docs.select(
        col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("bytes"),
        F.crc32(content).alias("text_crc32"),
        F.xxhash64(content).alias("h1"),
        F.xxhash64(F.lit(1), content).alias("h2"),
        F.monotonically_increasing_id().alias("uid"),
        F.array(*[_coordinate(docs, d) for d in dimensions], F.lit(0.0)).alias("at"),
    )
    return materialize(rows, "rows")


def _cut(level: DataFrame, nodes: dict[int, int], spreads: list[float], leaf_bytes: float) -> DataFrame:
    """Every node of several shards cut in two at the weighted median of its widest dimension.

    ``nodes``: shards by node; a node is named by its first shard.  The driver sees a row or two
    per node: spreads, the item at the cut, and the item at the cut that remains.
    """
    spark, n = level.sparkSession, len(spreads)
    spans = level.groupBy("node").agg(
        F.sum("bytes").alias("bytes"),
        *[(F.max(F.col("at")[i]) - F.min(F.col("at")[i])).alias(f"s{i}") for i in range(n)],
    )
    plan, total = [], {}
    for row in spans.collect():
        if nodes.get(row.node, 1) > 1:
            widths = [row[f"s{i}"] / spreads[i] if spreads[i] else 0.0 for i in range(n)]
            total[row.node] = row.bytes
            plan.append((row.node, max(range(n), key=lambda i: widths[i])))
    dims = spark.createDataFrame(plan, "node long, dim int")  # a row per node
    placed = level.join(F.broadcast(dims), "node", "left")
    placed = placed.withColumn("v", F.when(F.col("dim").isNull(), 0.0).otherwise(F.col("at")[F.col("dim")])).drop("dim")
    order = [F.asc(c) for c in ("v", "h1", "h2", "piece")]
    summed = materialize(running_sum(placed, order, "upto", "bytes", ["node"]), "summed")

    def at(targets: dict[int, float]) -> dict[int, tuple]:
        wanted = spark.createDataFrame(list(targets.items()), "node long, aim double")
        hit = summed.join(F.broadcast(wanted), "node").where("upto - bytes < aim AND aim <= upto")
        return {r.node: r for r in hit.select("node", "upto", "bytes", "h1", "h2", "piece").collect()}

    aims = {node: total[node] * (nodes[node] // 2) / nodes[node] for node in total}
    cuts, retry, pinned = {}, {}, {}
    for node, hit in at(aims).items():
        below, aim = hit.upto - hit.bytes, aims[node]
        if min(aim - below, hit.upto - aim) <= TOLERANCE * leaf_bytes:
            cuts[node] = below if aim - below < hit.upto - aim else hit.upto
        elif aim >= hit.bytes:  # the heavy item goes left, and others make room for it
            pinned[node], retry[node] = (hit.h1, hit.h2, hit.piece, True), aim - hit.bytes
        else:  # it goes right, and others fill the left side
            pinned[node], retry[node] = (hit.h1, hit.h2, hit.piece, False), aim + hit.bytes
    for node, hit in at({k: max(v, 1e-9) for k, v in retry.items()}).items() if retry else ():
        aim, below = retry[node], hit.upto - hit.bytes
        cuts[node] = below if aim - below < hit.upto - aim else hit.upto
    made = [
        (k, nodes[k] // 2, float(cuts.get(k, retry.get(k, 0))), *pinned.get(k, (None, None, None, None))) for k in total
    ]
    kind = "node long, half long, cut double, p1 long, p2 long, p3 long, p_left boolean"
    told = summed.join(F.broadcast(spark.createDataFrame(made, kind)), "node", "left")
    own = (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")) & (F.col("piece") == F.col("p3"))
    left = F.when(F.coalesce(own, F.lit(False)), F.col("p_left")).otherwise(F.col("upto") <= F.col("cut"))
    node = F.when(F.col("half").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("half"))
    out = materialize(told.select(node.alias("node"), "h1", "h2", "piece", "bytes", "at"), "level")
    release(summed)
    return out


def kd_shards(
    docs: DataFrame,
    shards: int | None = 16,
    target_bytes: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    A node is split at the weighted median (by UTF-8 bytes of the text plus 1) along the widest of
    its ``dimensions`` until every leaf holds about ``target_bytes``, or a ``shards``-th of all.
    Equal texts (null counts as empty) have one place in the tree, that of their smallest doc_id, and
    so one shard; only a group that is larger than a whole shard is split, by doc_id.  Ties along a
    dimension are cut by the hash of the text, so one value may fill any number of shards.
    Null metadata count as -1.  Repeated rows are rows of their own in one shard.  ``slot`` numbers a
    shard's rows by doc_id from 0.  Fewer texts than shards leave shards empty.
    """
    dimensions = tuple(d for d in dimensions if d in docs.columns)
    rows = _rows(docs, text, doc_id, list(dimensions))
    n = len(dimensions) + 1
    whole = rows.agg(
        F.sum("bytes").alias("bytes"), *[(F.max(F.col("at")[i]) - F.min(F.col("at")[i])).alias(f"s{i}") for i in range(n)]
    ).first()
    count = max(1, math.ceil((whole.bytes or 0) / target_bytes)) if target_bytes else shards
    leaf = (whole.bytes or 0) / count
    spreads = [whole[f"s{i}"] or 0.0 for i in range(n)]

    groups = rows.groupBy("h1", "h2").agg(F.sum("bytes").alias("group_bytes"))
    heavy = groups.where(F.col("group_bytes") > leaf).collect() if leaf else []  # fewer than there are shards
    pieces = rows.sparkSession.createDataFrame(
        [(r.h1, r.h2, 4 * math.ceil(r.group_bytes / leaf)) for r in heavy], "h1 long, h2 long, pieces int"
    )
    salt = F.pmod(F.xxhash64("doc_id", "uid"), F.col("pieces"))
    rows = rows.join(F.broadcast(pieces), ["h1", "h2"], "left").withColumn("piece", F.coalesce(salt, F.lit(0)).cast("long"))
    items = rows.groupBy("h1", "h2", "piece").agg(
        F.sum("bytes").alias("bytes"), F.min(F.struct("doc_id", "uid", "at")).alias("own")
    )
    level = materialize(items.select(F.lit(0).cast("long").alias("node"), "h1", "h2", "piece", "bytes", "own.at"), "level")
    nodes = {0: count}
    while whole.bytes and max(nodes.values()) > 1:
        before, level = level, _cut(level, nodes, spreads, leaf)
        release(before)
        nodes = {k: v for node, size in nodes.items() for k, v in _halves(node, size)}
    placed = rows.join(level.select("h1", "h2", "piece", F.col("node").alias("shard")), ["h1", "h2", "piece"])
    placed = placed.select("doc_id", "bytes", "text_crc32", "uid", "shard")
    slots = running_sum(placed, [F.asc("doc_id"), F.asc("uid")], "slot", keys=["shard"])
    return slots.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("slot") - 1).alias("slot"),
    )


def _halves(node: int, size: int) -> list[tuple[int, int]]:
    half = size // 2
    return [(node, size)] if size == 1 else [(node, half), (node + half, size - half)]
