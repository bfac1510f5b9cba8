"""Runs of many methods over many images: configurations are rows, results a table that grows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import metrics
from pixelweave.plans import denoise
from pixelweave.sources import staging

Method = Callable[..., DataFrame]

#: By name: raster (img, y, x, v), height, width, gain, variance and a configuration's own parameters to a filtered raster.
METHODS: dict[str, Method] = {
    "bm3d_novst": denoise.bm3d_plain,
    "bm3d_vst": denoise.bm3d_vst,
    "vbm3d_vst": denoise.vbm3d,
    "bilateral_vst": denoise.bilateral_vst,
    "nlm_vst": denoise.nlm_vst,
    "aknn": denoise.aknn_bm3d,
    "aknn_raw": denoise.aknn_bm3d_raw,
}
#: Methods that filter the groups of one search at several strengths in one pass.
SHARED = ("bm3d_novst", "bm3d_vst")


def _plans(configs: list[dict]) -> list[tuple[str, dict, list[tuple[str, float | None]]]]:
    """Configurations that share a search together: (method, parameters, [(configuration, strength)])."""
    groups: dict[tuple[str, str], list[tuple[str, float | None]]] = {}
    for c in configs:
        own = {k: v for k, v in c.items() if k != "method"}
        strength = own.pop("strength", denoise.LAMBDA) if c["method"] in SHARED else None
        groups.setdefault((c["method"], json.dumps(own, sort_keys=True)), []).append((json.dumps(c, sort_keys=True), strength))
    return [(method, json.loads(own), members) for (method, own), members in groups.items()]


def run(images: DataFrame, height: int, width: int, a: float, b: float, configs: list[dict], results: str | None = None) -> DataFrame:
    """Filter and score images (img, y, x, v, clean) by each configuration: rows (method, config, img, psnr_noisy, psnr).

    A configuration names its method and parameters. Those that differ in strength only share one
    search. Each search is one job, whose rows are appended to the table at `results` when it is done;
    pairs of image and configuration that the table holds already are left out by an anti-join, so a
    run that was cut short, or got more images or configurations, goes on where it was.
    """
    spark = images.sparkSession
    if results is None:
        results = f"{staging.shared_dir(spark)}/results-{uuid.uuid4().hex}"
        staging.until_exit(spark, results)
    schema = "method string, config string, img int, psnr_noisy double, psnr double"

    def table() -> DataFrame:
        return spark.read.schema(schema).parquet(results) if staging.finished(spark, results) else spark.createDataFrame([], schema)

    norm = lambda c: F.least(F.greatest((F.col(c) - 240.0) / 3855.0, F.lit(0.0)), F.lit(1.0))
    for method, own, members in _plans(configs):
        named = F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.lit(k).alias("variant")) for k, (c, _) in enumerate(members))))
        todo = images.select("img").distinct().select("img", named.alias("m")).select("img", "m.*")
        todo = todo.join(table().where(F.col("method") == method).select("img", "config"), ["img", "config"], "left_anti").persist()
        left = sorted(r["variant"] for r in todo.select("variant").distinct().collect())  # configurations, not images
        if left:
            # a video method needs the frames around an image, so only whole-image methods leave finished images out
            some = images if method == "vbm3d_vst" else images.join(todo.select("img").distinct(), "img", "left_semi")
            raw = some.select("img", "y", "x", "v")
            if method in SHARED:
                out = METHODS[method](raw, height, width, a, b, strengths=tuple(members[k][1] for k in left), **own)
                place = F.col("variant") + 1 if len(left) > 1 else F.lit(1)
                out = out.withColumn("variant", F.element_at(F.array(*(F.lit(k) for k in left)), place))
            else:
                out = METHODS[method](raw, height, width, a, b, **own).withColumn("variant", F.lit(left[0]))
            both = out.withColumnRenamed("v", "f").join(some, ["img", "y", "x"])
            score = both.select("variant", "img", "f", norm("v").alias("n"), norm("clean").alias("c")).groupBy("variant", "img").agg(
                metrics.psnr(metrics.mse("n", "c"), 1.0).alias("psnr_noisy"), metrics.psnr(metrics.mse("f", "c"), 1.0).alias("psnr")
            )
            rows = score.join(todo, ["img", "variant"]).select(F.lit(method).alias("method"), "config", F.col("img").cast("int").alias("img"), "psnr_noisy", "psnr")
            rows.write.mode("append").parquet(results)
        todo.unpersist()
    return table()
