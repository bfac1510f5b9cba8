"""Synthetic noise whose draws depend on the pixel and a seed, not on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import streams
from pixelweave.operators import ranks

_UNIT = 2.0**-52


def uniform(seed: int, salt: int) -> Column:
    """A number in (0, 1) from image, row, column, seed and salt."""
    h = F.xxhash64("img", "y", "x", F.lit(seed), F.lit(salt))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) * _UNIT


def normal(seed: int) -> Column:
    """A standard normal number by Box and Muller, inside generated code."""
    return F.sqrt(-2.0 * F.log(uniform(seed, 1))) * F.cos(uniform(seed, 2) * (2 * np.pi))


def awgn(df: DataFrame, sigma: float, *, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """White Gaussian noise, clipped."""
    return df.withColumn("v", F.least(F.greatest(F.col("v") + normal(seed) * sigma, F.lit(low)), F.lit(high)))


def poisson_gaussian(df: DataFrame, a: float, sigma: float, *, seed: int) -> DataFrame:
    """Signal-dependent noise: a scaled Poisson number of mean v / a, plus a Gaussian one, clipped to [0, 1].

    The Poisson number inverts its distribution at the pixel's own uniform number, a batch of pixels at a time.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mean = np.maximum(b["v"].to_numpy() / a, 1e-10)
            term = np.exp(-mean)
            total, count = term.copy(), np.zeros(len(b))
            u, k = b["u"].to_numpy(), 0
            while (on := u > total).any() and k < 10 * mean.max() + 100:
                k += 1
                term = term * mean / k
                count[on] += 1
                total = total + term
            b["v"] = np.clip(count * a + b["g"].to_numpy() * sigma, 0, 1)
            yield b[["img", "y", "x", "v"]]

    drawn = df.select("img", "y", "x", "v", uniform(seed, 3).alias("u"), normal(seed).alias("g"))
    return drawn.mapInPandas(draw, "img int, y int, x int, v double")


def stream_awgn_u8(files: DataFrame, width: int, sigma: float, *, seed: int) -> DataFrame:
    """White Gaussian noise from one stream over files in the order of their names: (name, y, x, v), eight bits, cut to whole numbers.

    A pixel's place in the stream is the number of pixels in the files before its own, from prefix
    sums of their sizes, and its place in the file. Equal names are one file; a file may be missing
    pixels, then its size is what it has.
    """
    sizes = files.groupBy("name").agg(F.count("*").alias("n"))
    first = ranks.before(sizes, [], ["name"], "first", "n").select("name", "first")
    place = F.col("first") + F.col("y") * width + F.col("x")
    noisy = F.col("v") + streams.normal(place.cast("long"), seed) * sigma
    return files.join(first, "name").select("name", "y", "x", F.floor(F.least(F.greatest(F.round(noisy, 9), F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))
