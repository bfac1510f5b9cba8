"""Headline queries, timed: prints one JSON line. Those on a raster that grows with the tables also as pixels a second."""

import json
import os
import time

from pyspark.sql import SparkSession

from pixelweave.queries import QUERIES
from pixelweave.sources import rasters

NAMES = ("gaussian_filter", "bilateral", "yaroslavsky", "nlm", "match_ssd_topk", "bm3d_vst", "vbm3d_vst", "aknn_bm3d")
GROWN = ("bilateral_grown", "yaroslavsky_grown", "nlm_grown", "match_grown", "bm3d_grown")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("mse", "guide_blur"):  # starts the JVM's code and the Python workers
        QUERIES[name](spark, sf_dir).collect()
    took = {}
    for name in (*NAMES, *GROWN):
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    pixels = rasters.side(spark, sf_dir) ** 2
    rates = {name: round(pixels / took[name]) for name in GROWN}
    total = round(sum(took[n] for n in NAMES), 3)  # of the queries that earlier rounds timed too
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "pixels": pixels, "pixels_per_sec": rates, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
