"""Layouts: mosaics, tiles, crops, borders and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pack_bayer(df: DataFrame) -> DataFrame:
    """Mosaic (img, y, x, v) to four channels on a grid of half the size; channel = 2 * (y mod 2) + x mod 2."""
    y, x = F.col("y"), F.col("x")
    return df.select("img", F.floor(y / 2).cast("int").alias("y"), F.floor(x / 2).cast("int").alias("x"), (y % 2 * 2 + x % 2).cast("int").alias("ch"), "v")


def unpack_bayer(df: DataFrame) -> DataFrame:
    """Channels back to the mosaic."""
    return df.select(
        "img", (F.col("y") * 2 + F.floor(F.col("ch") / 2)).cast("int").alias("y"), (F.col("x") * 2 + F.col("ch") % 2).cast("int").alias("x"), "v"
    )


def starts(size: int, block: int, overlap: int) -> list[int]:
    """Where tiles start on an axis: in steps of block - overlap; the last is moved back to the edge."""
    step = block - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the tile")
    return sorted({min(s, max(size - block, 0)) for s in range(0, size, step)})


def tile_grid(spark: SparkSession, height: int, width: int, block: tuple[int, int], overlap: int) -> DataFrame:
    """Half-open tile rectangles (y0, y1, x0, x1); a tile is shorter only if the raster is."""
    ys, xs = starts(height, block[0], overlap), starts(width, block[1], overlap)
    rows = [(y, min(y + block[0], height), x, min(x + block[1], width)) for y in ys for x in xs]
    return spark.createDataFrame(rows, "y0 int, y1 int, x0 int, x1 int")


def quadrants(spark: SparkSession, height: int, width: int, overlap: int) -> DataFrame:
    """Four tiles that reach `overlap` beyond the middle. A negative start counts from the end, as slices do."""
    h, w = height // 2, width // 2
    ends = lambda a, b, n: (max(a + n, 0) if a < 0 else a, min(b, n))
    ys, xs = [ends(0, h + overlap, height), ends(h - overlap, height, height)], [ends(0, w + overlap, width), ends(w - overlap, width, width)]
    return spark.createDataFrame([(*y, *x) for y in ys for x in xs], "y0 int, y1 int, x0 int, x1 int")


def split_tiles(df: DataFrame, height: int, width: int, block: tuple[int, int], overlap: int) -> DataFrame:
    """Each pixel once for every tile that holds it: adds y0, x0. No join: the starts on an axis are literals."""

    def holding(axis: str, size: int, length: int) -> Column:
        all_starts = F.array(*(F.lit(s) for s in starts(size, length, overlap)))
        return F.explode(F.filter(all_starts, lambda s: (s <= F.col(axis)) & (F.col(axis) < s + length)))

    tall = df.withColumn("y0", holding("y", height, block[0]))
    return tall.withColumn("x0", holding("x", width, block[1]))


def merge_tiles(df: DataFrame, keys: tuple[str, ...] = ("img", "y", "x"), value: str = "v") -> DataFrame:
    """Tiles back to a raster: the mean where they overlap."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def crop(df: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """A window with its own origin."""
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return df.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def center_crop(df: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """The middle window. Its origin must be even, so that the color pattern stays in phase."""
    y0, x0 = (height - new_height) // 2, (width - new_width) // 2
    if y0 % 2 or x0 % 2:
        raise ValueError("the origin of the crop must be even")
    return crop(df, y0, x0, new_height, new_width)


def reference_grid(spark: SparkSession, height: int, width: int, patch: int, stride: int, *, centered: bool = False) -> DataFrame:
    """Reference positions: top-left corners of patches that fit, or centers."""
    r = patch // 2 if centered else 0
    ends = (height - r, width - r) if centered else (height - patch + 1, width - patch + 1)
    rows = spark.range(r, ends[0], stride).select(F.col("id").cast("int").alias("ref_y"))
    return rows.select("ref_y", F.explode(F.sequence(F.lit(r), F.lit(ends[1] - 1), F.lit(stride))).alias("ref_x"))


def mirrored(at: Column, size: int, border: str) -> Column:
    """An index beyond the border: `reflect` repeats the edge, `reflect101` doesn't, `edge` stays on it."""
    if border == "edge":
        return F.least(F.greatest(at, F.lit(0)), F.lit(size - 1))
    skip = {"reflect": 0, "reflect101": 1}[border]
    return F.when(at < 0, -at - 1 + skip).when(at >= size, 2 * size - 1 - skip - at).otherwise(at)


def padded(df: DataFrame, spark: SparkSession, height: int, width: int, margin: int, border: str) -> DataFrame:
    """A raster with a margin; indices stay those of the raster, and are negative in the margin. `constant` fills it with zeros."""
    zero = border == "constant"
    border = "edge" if zero else border
    lines = lambda n: F.sequence(F.lit(-margin), F.lit(n + margin - 1))
    cells = spark.range(1).select(F.explode(lines(height)).alias("y")).select("y", F.explode(lines(width)).alias("x"))
    cells = cells.select("y", "x", mirrored(F.col("y"), height, border).alias("sy"), mirrored(F.col("x"), width, border).alias("sx"))
    source = df.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    inside = (F.col("y") == F.col("sy")) & (F.col("x") == F.col("sx"))
    value = F.when(inside, F.col("v")).otherwise(F.lit(0).cast(df.schema["v"].dataType)) if zero else F.col("v")
    return source.join(cells, ["sy", "sx"]).select("img", "y", "x", value.alias("v"))
