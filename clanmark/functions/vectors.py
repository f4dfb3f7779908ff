"""Vector arithmetic on ``array<double>`` columns (JVM side, DOUBLE throughout)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clanmark.functions.sums import vector_sums

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_double(vector: ColumnLike) -> Column:
    return _col(vector).cast("array<double>")


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(_col(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def scale_by(vector: ColumnLike, divisor: Column) -> Column:
    """Divide every element by ``divisor``; unchanged where the divisor is 0.

    The divisor is repeated into an array so that it is computed once per row; inside
    a lambda Spark would evaluate it again for every element.
    """
    v = _col(vector)
    repeated = F.array_repeat(divisor, F.size(v))
    return F.zip_with(v, repeated, lambda x, d: F.when(d != 0, x / d).otherwise(x))


def l2_normalize(vector: ColumnLike) -> Column:
    """v / |v|; the zero vector is returned unchanged."""
    return scale_by(vector, norm(vector))


def cosine_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """dot / (|a| |b|), and 0.0 if either norm is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_distance_abs(a: ColumnLike, b: ColumnLike) -> Column:
    """1 - |cos|: opposite vectors count as identical.  NULL for a zero vector."""
    return F.lit(1.0) - F.abs(F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_distance_xy(a: ColumnLike, b: ColumnLike, epsilon: float = 1e-12) -> Column:
    """1 - cos with ``epsilon`` added to each norm."""
    return F.lit(1.0) - dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def clipped_distance(similarity: ColumnLike) -> Column:
    """clip(1 - similarity, 0, 2)."""
    return F.least(F.greatest(F.lit(1.0) - _col(similarity), F.lit(0.0)), F.lit(2.0))


def euclidean_distance(a: ColumnLike, b: ColumnLike) -> Column:
    squares = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def standardize(vector: ColumnLike) -> Column:
    """(x - mean) / max(population stddev, 1/sqrt(n)), per vector."""
    v = _col(vector)
    n = F.size(v)
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), n.cast("double"))
    centred = F.zip_with(v, F.array_repeat(mean, n), lambda x, m: x - m)
    return F.when(n > 0, _divide_by_spread(centred)).otherwise(v)


def _divide_by_spread(centred: Column) -> Column:
    n = F.size(centred).cast("double")
    spread = norm(centred) / F.sqrt(n)
    return scale_by(centred, F.greatest(spread, F.lit(1.0) / F.sqrt(n)))


def is_finite(vector: ColumnLike) -> Column:
    """Non-null, and no element is null, NaN or infinite."""
    infinite = F.lit(float("inf"))
    return F.coalesce(
        F.forall(_col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)),
        F.lit(False),
    )


def dimension_of(df: DataFrame, vector: str) -> int:
    """The length that most vectors of the table have, the longer one of two as frequent.

    A vector of another length has no direction, as null, empty, zero and non-finite ones.
    """
    sizes = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max(F.struct("n", "d")).alias("m")).select("m.d").first()
    return int(row["d"] or 0)


def of_length(vector: str, dim: int) -> Column:
    """The vector if it has ``dim`` elements, else NULL."""
    return F.when(F.size(vector) == dim, F.col(vector))


def divided(vector: ColumnLike, count: str) -> Column:
    """Every element divided by a count column; nulls where that is 0."""
    return F.zip_with(_col(vector), F.array_repeat(F.col(count), F.size(_col(vector))), lambda x, n: F.try_divide(x, n))


def mean_vectors(
    df: DataFrame, keys: list[str], vector: str, dim: int | None = None, out: str = "centroid"
) -> DataFrame:
    """Element-wise mean of ``vector`` per key, with the row count as ``size``.

    The mean is that of the vectors of ``dim`` elements (by default the usual length of the
    table); other rows count in ``size`` only, and a key without such a vector has a mean of nulls.
    """
    dim = dimension_of(df, vector) if dim is None else dim
    counts = {"size": F.lit(1).cast("long"), "_n": F.when(F.size(vector) == dim, 1).otherwise(0).cast("long")}
    return vector_sums(df, keys, vector, dim, counts).select(*keys, "size", divided("_sum", "_n").alias(out))


def unit_centroids(
    df: DataFrame, keys: list[str], vector: str, dim: int | None = None
) -> DataFrame:
    """Mean then unit length, per key; a key without vectors gets zeros of ``dim``."""
    dim = dimension_of(df, vector) if dim is None else dim
    means = mean_vectors(df, keys, vector, dim)
    zeros = F.transform(F.col("centroid"), lambda x: F.coalesce(x, F.lit(0.0)))
    return means.withColumn("centroid", zeros).withColumn("centroid", l2_normalize("centroid"))


def mean_of_variants(
    df: DataFrame, item: str, variant: str, vector: str, dim: int | None = None, limit: int | None = None
) -> DataFrame:
    """Per item: mean of the base vector and its variants, failed ones skipped.

    ``variant`` is NULL for the base row and 0, 1, … for variants.  Variant 0 is the
    unmodified observation, so the base counts twice.  Items without a base vector
    give no row, vectors of another length than ``dim`` count as failed.  ``limit`` keeps
    only the variants below that number.
    """
    base = F.col(variant).isNull()
    dim = dimension_of(df, vector) if dim is None else dim
    usable = df.where(of_length(vector, dim).isNotNull())
    if limit is not None:
        usable = usable.where(base | (F.col(variant) < limit))
    counts = {"n_vectors": F.lit(1).cast("long"), "_base": F.when(base, 1).otherwise(0).cast("long")}
    sums = vector_sums(usable, [item], vector, dim, counts).where("_base > 0")
    return sums.select(item, "n_vectors", divided("_sum", "n_vectors").alias("centroid"))
