"""Orthonormal transforms of patch groups as joins with a basis and sums, thresholds and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import kernels


def along(df: DataFrame, keys: list[str], axis: str, matrices: dict[int, list[list[float]]], size: str | None = None, value: str = "v") -> DataFrame:
    """Apply a matrix along one axis: out[r] = sum over c of matrix[r][c] * value at axis = c.

    `keys` are the columns that stay (the other axes among them). With `size`, each group uses the
    matrix of its own size. The basis has at most a few thousand rows, whatever the data, and is
    broadcast; the sum combines on the map side.
    """
    spark = df.sparkSession
    b = kernels.basis(spark, matrices, ("bsize", "r", "c", "b"))
    on = F.col(axis) == F.col("c")
    if size:
        on = on & (F.col(size) == F.col("bsize"))
    joined = df.join(F.broadcast(b), on)
    return joined.groupBy(*keys, F.col("r").alias(axis)).agg(F.sum(F.col("b") * F.col(value)).alias(value))


def transposed(m: list[list[float]]) -> list[list[float]]:
    return [list(r) for r in zip(*m, strict=True)]


def dct2(df: DataFrame, keys: list[str], n: int, *, inverse: bool = False, value: str = "v") -> DataFrame:
    """Two-dimensional DCT of patches (keys, i, j, v)."""
    m = kernels.dct(n)
    m = transposed(m) if inverse else m
    return along(along(df, [*keys, "j"], "i", {n: m}, value=value), [*keys, "i"], "j", {n: m}, value=value)


def group_axis(df: DataFrame, keys: list[str], sizes: range, kind: str = "dct", *, inverse: bool = False) -> DataFrame:
    """One-dimensional transform over the members `k` of groups whose column `size` says how many they are."""
    if kind == "dct":
        m = {n: transposed(kernels.dct(n)) if inverse else kernels.dct(n) for n in sizes}
    else:
        m = {n: kernels.haar(n)[1 if inverse else 0] for n in sizes}
    return along(df, keys, "k", m, "size")


def thresholded(df: DataFrame, limit: F.Column | float, value: str = "v") -> DataFrame:
    """Coefficients below the limit become zero. Compared at nine decimals, so that no last bit decides."""
    limit = F.lit(limit) if isinstance(limit, float) else limit
    return df.withColumn(value, F.when(F.round(F.abs(F.col(value)), 9) < limit, 0.0).otherwise(F.col(value)))


def weights(df: DataFrame, keys: list[str], variance: str | None = None, value: str = "v") -> DataFrame:
    """Of each group: its coefficients that are not zero, and the weight 1 / (count * variance), or 1 / variance without any."""
    n = F.count_if(F.col(value) != 0)
    var = F.first(variance) if variance else F.lit(1.0)
    return df.groupBy(*keys).agg(n.alias("n_nz"), (1.0 / (F.greatest(n, F.lit(1)).cast("double") * var)).alias("w"))


def scatter(members: DataFrame, weight: str = "w", window: DataFrame | None = None) -> DataFrame:
    """Filtered patches back on the raster: weighted mean of all that cover a pixel.

    members: (img, y, x, i, j, v, w), y and x a patch's corner; `window` may add a weight by (i, j).
    """
    w = F.col(weight)
    if window is not None:
        members = members.join(F.broadcast(window), ["i", "j"])
        w = w * F.col("win")
    at = [F.col("img"), (F.col("y") + F.col("i")).cast("int").alias("y"), (F.col("x") + F.col("j")).cast("int").alias("x")]
    return members.groupBy(*at).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def covered(noisy: DataFrame, filtered: DataFrame) -> DataFrame:
    """Pixels that no patch covers keep their noisy value."""
    return noisy.join(filtered.withColumnRenamed("v", "f"), ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("f", "v").alias("v"))
