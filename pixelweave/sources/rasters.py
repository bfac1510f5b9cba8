"""Pixel tables and catalogues built from the star-schema tables.

A raster is a table (img, y, x, v); a sequence has its frame number as `img`. Empty cells of a
dense grid are filled, so every raster is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLACK, WHITE = 240, 4095


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """All cells (y, x) of a raster."""
    row = spark.range(height).select(F.col("id").cast("int").alias("y"))
    return row.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def dense_raw(sums: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Integer sums as sensor values between black and white level; cells without rows are black."""
    value = (F.lit(BLACK) + F.coalesce("q", F.lit(0)) % (WHITE - BLACK + 1)).cast("int")
    return cells.join(sums, keys, "left").select(*keys, value.alias("v"))


def raw32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 32 x 32 sensor image, image number 0."""
    at = [(F.col("l_orderkey") % 32).cast("int").alias("y"), (F.col("l_partkey") % 32).cast("int").alias("x")]
    sums = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.sum("l_quantity").cast("long").alias("q"))
    return dense_raw(sums, grid(spark, 32, 32), ["y", "x"]).select(F.lit(0).alias("img"), "y", "x", "v")


def frames16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven 16 x 16 frames, or seven realizations of one frame."""
    at = [F.col("l_linenumber").cast("int").alias("img"), (F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x")]
    sums = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.sum("l_quantity").cast("long").alias("q"))
    cells = grid(spark, 16, 16).select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("img"), "y", "x")
    return dense_raw(sums, cells, ["img", "y", "x"])


def stacks16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scenes of seven realizations each, 16 x 16."""
    at = [
        (F.col("l_suppkey") % 4).cast("int").alias("scene"), F.col("l_linenumber").cast("int").alias("img"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x"),
    ]
    sums = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.sum("l_quantity").cast("long").alias("q"))
    cells = grid(spark, 16, 16).select("y", "x", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("img"))
    cells = cells.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scene"), "img", "y", "x")
    return dense_raw(sums, cells, ["scene", "img", "y", "x"])


def clips16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sequences of seven frames, 16 x 16: (seq, frame, y, x, v). Frame numbers have gaps, and each sequence its own."""
    seq = (F.col("l_suppkey") % 3).cast("int")
    at = [
        seq.alias("seq"), (F.col("l_linenumber") * (F.col("l_linenumber") + seq)).cast("int").alias("frame"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x"),
    ]
    sums = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.sum("l_quantity").cast("long").alias("q"))
    cells = grid(spark, 16, 16).select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    cells = cells.select("seq", F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: n * (n + F.col("seq")))).alias("frame"), "y", "x")
    return dense_raw(sums, cells, ["seq", "frame", "y", "x"])


def side(spark: SparkSession, sf_dir: str) -> int:
    """The side of a square raster with about ten sold items a pixel: a power of two, at least 32, that grows with the tables."""
    rows, n = table(spark, sf_dir, "lineitem").count(), 32  # one number
    while 10 * n * n < rows:
        n *= 2
    return n


def raw_grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """One sensor image whose side grows with the tables, and that side."""
    n = side(spark, sf_dir)
    at = [F.pmod(F.col("l_orderkey"), F.lit(n)).cast("int").alias("y"), F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(n)).cast("int").alias("x")]
    sums = table(spark, sf_dir, "lineitem").groupBy(*at).agg((F.sum("l_quantity") * 9).cast("long").alias("q"))
    return dense_raw(sums, grid(spark, n, n), ["y", "x"]).select(F.lit(0).alias("img"), "y", "x", "v"), n


def emb_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-valued raster: one row of pixels for each vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("img"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn(
        "v", F.col("v").cast("double")
    )


def clean16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the realizations, rounded down: the clean frame."""
    return frames16(spark, sf_dir).groupBy("y", "x").agg(F.floor(F.avg("v")).cast("int").alias("clean"))


def rgb16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Color pixels (y, x, r, g, b) of eight bits."""
    eight = lambda k: F.max(F.when(F.col("img") == k, F.col("v") % 256))
    return frames16(spark, sf_dir).groupBy("y", "x").agg(eight(1).alias("r"), eight(2).alias("g"), eight(3).alias("b"))


def iso_of_event() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "signup", 1600).when(kind == "view", 3200).when(kind == "error", 6400).when(kind == "click", 12800).otherwise(25600)


def noise_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise parameters with repeated keys and negative b."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("scene"), (F.col("user_id") % 11 + 1).cast("string")).alias("scene"), iso_of_event().alias("iso"),
        (F.col("event_id") % 7 + 1).cast("int").alias("frame"), (F.col("event_id") % 10).cast("int").alias("noisy_idx"),
        "event_id", F.col("value").alias("a"), F.round(F.col("value") - 20, 2).alias("b"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of clean and noisy files."""
    o, s = table(spark, sf_dir, "orders"), lambda c: c.cast("string")
    kind = F.when(F.col("o_orderkey") % 11 == 0, F.lit("_clean")).otherwise(F.concat(F.lit("_noisy"), s(F.col("o_orderkey") % 10)))
    return o.select(
        F.concat(
            F.lit("data/noisy/scene"), s(F.col("o_custkey") % 11 + 1), F.lit("/ISO"), s((F.col("o_orderkey") % 5 + 1) * 1600),
            F.lit("/frame"), s(F.col("o_orderkey") % 7 + 1), kind, F.lit(".tiff"),
        ).alias("path")
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of methods by frame and sensitivity."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("method"), iso_of_event().alias("iso"), (F.col("event_id") % 7 + 1).cast("int").alias("frame"), F.col("value").alias("psnr")
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with their camera, its color pattern and noise coefficients by color."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    pattern = F.when(F.col("r_regionkey") % 4 == 0, "RGGB").when(F.col("r_regionkey") % 4 == 1, "BGGR").when(F.col("r_regionkey") % 4 == 2, "GRBG").otherwise("GBRG")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lpad(k.cast("string"), 4, "0"), F.lit("_001_"), F.col("r_name"), F.lit("_10000_N")).alias("scene_instance_id"),
        F.col("r_name").alias("camera_id"), pattern.alias("bayer_pattern"),
        *(((k + i).cast("double") / 1000.0).alias(f"beta1_{c}") for i, c in ((1, "r"), (2, "g"), (3, "b"))),
        *(((k - i).cast("double") / 100000.0).alias(f"beta2_{c}") for i, c in ((3, "r"), (2, "g"), (1, "b"))),
    )
