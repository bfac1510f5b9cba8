"""Image quality, statistics, noise calibration and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators import ranks
from pixelweave.operators.stencil import window_means


def mse(a: str, b: str) -> Column:
    d = F.col(a).cast("double") - F.col(b)
    return F.avg(d * d)


def psnr(error: Column, peak: float) -> Column:
    """Decibels of a mean squared error; infinite for equal images."""
    return F.when(error > 0, 10.0 * F.log10(F.lit(peak * peak) / error)).when(error == 0, F.lit(float("inf")))


def ssim(pairs: DataFrame, height: int, width: int, data_range: float, *, radius: int = 3) -> DataFrame:
    """Mean structural similarity of images (img, y, x, a, b), uniform window, sample covariance, inner pixels.

    Five means over each window suffice; a tile takes them from arrays of both images.
    """
    n = float((2 * radius + 1) ** 2)
    two = F.explode(F.array(*(F.struct(F.lit(k).alias("ch"), F.col(c).cast("double").alias("v")) for k, c in enumerate("ab"))))
    inner = window_means(pairs.select("img", "y", "x", two.alias("c")).select("img", "y", "x", "c.*"), height, width, radius)
    c1, c2, scale = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2, n / (n - 1)
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = (F.col("aa") - ma * ma) * scale, (F.col("bb") - mb * mb) * scale, (F.col("ab") - ma * mb) * scale
    value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return inner.groupBy("img").agg(F.avg(value).alias("ssim"))


def pixel_statistics(df: DataFrame, black: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and sample variance of each pixel over the images of a stack, or of each stack by its keys."""
    v = F.col("v") - black
    return df.groupBy(*keys, "y", "x").agg(F.avg(v).alias("m"), F.var_samp(v).alias("var"))


def mean_bounds(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The 5th and 95th percentile of the pixels' means, the lower one not below zero: (keys, lo, hi)."""
    q = ranks.percentiles(stats, keys, "m", ["y", "x"], [0.05, 0.95])
    return q.groupBy(*keys).agg(F.greatest(F.max(F.when(F.col("p") < 0.5, F.col("m"))), F.lit(0.0)).alias("lo"), F.max(F.when(F.col("p") > 0.5, F.col("m"))).alias("hi"))


def calibration(stacks: DataFrame, black: float, peak: float, keys: tuple[str, ...], least: int = 100) -> DataFrame:
    """For each stack of repeated images: gain a and offset b of its noise, as by `noise_fit`, and the mean PSNR of its
    images against their mean, rounded down. Rows of (keys, img, y, x, v)."""
    stats = pixel_statistics(stacks, black, keys)
    bounds = mean_bounds(stats, list(keys))
    used, enough = stats.join(bounds, list(keys)).where("m >= lo and m <= hi and var >= 0"), F.count("*") >= least
    fit = used.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(enough, F.regr_slope("var", "m")).alias("a"), F.when(enough, F.regr_intercept("var", "m")).alias("b")
    )
    clean = stats.select(*keys, "y", "x", F.floor(F.col("m") + black).alias("clean"))
    each = stacks.join(clean, [*keys, "y", "x"]).groupBy(*keys, "img").agg(psnr(mse("v", "clean"), peak).alias("psnr"))
    return fit.join(each.groupBy(*keys).agg(F.avg("psnr").alias("psnr")), list(keys))


def noise_fit(stats: DataFrame, least: int = 100) -> DataFrame:
    """Gain a and offset b of var = a * mean + b, over pixels between the 5th and 95th percentile of the mean.

    Null if fewer than `least` pixels remain. The bounds are one row.
    """
    used = stats.crossJoin(F.broadcast(mean_bounds(stats, []))).where("m >= lo and m <= hi and var >= 0")
    enough = F.count("*") >= least
    return used.agg(
        F.count("*").alias("n"), F.when(enough, F.regr_slope("var", "m")).alias("a"), F.when(enough, F.regr_intercept("var", "m")).alias("b")
    )


def image_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and count by key; nulls and NaN don't count."""
    known = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(key).agg(F.avg(known).alias("mean"), F.count(known).alias("n"))


def amortized(rows: DataFrame, keys: list[str], frame: str, time: str) -> DataFrame:
    """Seconds a frame of each sequence: all its time over its number of frames."""
    return rows.groupBy(*keys).agg(F.count_distinct(frame).alias("frames"), F.sum(time).alias("total")).withColumn("per_frame", F.col("total") / F.col("frames"))


def elapsed(rows: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """Time so far, and its mean a step, along each sequence."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"elapsed": F.sum(time).over(so_far), "mean_step": F.avg(time).over(so_far)})


def shares(counts: DataFrame, value: str, count: str) -> DataFrame:
    """A histogram with each bin's percentage and the mean of all; the total is one row."""
    total = counts.agg(F.sum(count).alias("all"), F.sum(F.col(value) * F.col(count)).alias("moment"))
    return counts.join(F.broadcast(total)).select(
        value, count, (100.0 * F.col(count) / F.col("all")).alias("percent"), (F.col("moment") / F.col("all")).alias("mean")
    )


def local_variance(patch_rows: DataFrame, keys: list[str], a: float, b: float, floor: float = 1e-12, factor: float = 2.7) -> DataFrame:
    """Noise variance of each reference patch from its mean, and the threshold for its group."""
    var = F.greatest(F.lit(a) * F.avg("v") + b, F.lit(floor))
    return patch_rows.groupBy(*keys).agg(var.alias("variance"), (F.sqrt(var) * factor).alias("limit"))
