"""Global ranks, percentiles, one random stream, and resumable runs, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import streams
from pixelweave.operators import catalogue, ranks
from pixelweave.plans import denoise, runner
from pixelweave.sources import noise, rasters
from tests.conftest import SF


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]) if r.random() < 0.5 else "hot", r.choice([1.5, 2.5, r.random()]), i, r.randrange(5)) for i in range(900)]
    return spark.createDataFrame(rows, "g string, v double, i int, n int").repartition(7), rows


def test_ranks_and_prefix_sums(table):
    df, rows = table
    got = {r["i"]: (r["rank"], r["sum"]) for r in ranks.before(ranks.before(df, ["g"], ["v", "i"], "rank"), ["g"], ["v", "i"], "sum", "n").collect()}
    for g in {r[0] for r in rows}:
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 0
        for k, r in enumerate(own):
            assert got[r[2]] == (k, total)
            total += r[3]
    assert ranks.before(df.where("false"), [], ["v", "i"], "rank").count() == 0


def test_percentiles(table):
    df, rows = table
    got = {(r["g"], r["p"]): r["v"] for r in ranks.percentiles(df, ["g"], "v", ["i"], [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.quantile([r[1] for r in rows if r[0] == g], p), abs=1e-12)
    assert len(got) == 5 * len({r[0] for r in rows})


def test_pairs_by_position(spark):
    left = spark.createDataFrame([("s", x) for x in "dbca"] + [("t", "z")], "scene string, path string")
    right = spark.createDataFrame([("s", x) for x in "yx"], "scene string, path string")
    got = catalogue.by_position(left, right, "scene", "path").collect()
    assert sorted(map(tuple, got), key=str) == [("s", 1, "a", "x"), ("s", 2, "b", "y"), ("s", 3, "c", None), ("s", 4, "d", None), ("t", 1, "z", None)]


def test_a_stream_can_be_entered_anywhere(spark):
    places = [0, 1, 2, 3, 1000, 10**6, 7 * 10**13]
    got = [r["u"] for r in spark.createDataFrame([(p,) for p in places], "p long").select(streams.uniform(F.col("p"), 99).alias("u")).collect()]
    (m1, a1), (m2, a2) = streams.GENERATORS
    x1, x2 = streams.seeds(99)
    for p, u in zip(places, got, strict=True):
        assert u == ((x1 * pow(a1, p, m1) % m1 - x2 * pow(a2, p, m2) % m2 - 1) % (m1 - 1) + 1) / m1
    drawn = spark.range(20000).select(streams.normal(F.col("id"), 5).alias("z")).agg(F.avg("z"), F.stddev("z"), F.avg(F.col("z") ** 3)).first()
    assert abs(drawn[0]) < 0.03 and abs(drawn[1] - 1) < 0.03 and abs(drawn[2]) < 0.1


def test_stream_noise_does_not_depend_on_partitions(spark):
    files = spark.createDataFrame([(n, y, x, 100) for n, h in (("b", 3), ("a", 5), ("c", 2)) for y in range(h) for x in range(4)], "name string, y int, x int, v int")
    one, many = (sorted(map(tuple, noise.stream_awgn_u8(f, 4, 15.0, seed=1).collect())) for f in (files.coalesce(1), files.repartition(9)))
    assert one == many
    place = {("a", 0): 0, ("b", 0): 20, ("c", 0): 32}  # pixels before each file
    z = [r["z"] for r in spark.createDataFrame([(p,) for p in place.values()], "p long").select(streams.normal(F.col("p"), 1).alias("z")).collect()]
    assert [r[3] for r in one if (r[1], r[2]) == (0, 0)] == [int(np.clip(round(100 + 15 * v, 9), 0, 255)) for v in z]


def test_runs_are_resumed(spark, tmp_path):
    pairs = rasters.frames16(spark, SF).join(rasters.clean16(spark, SF), ["y", "x"]).select("img", "y", "x", "v", "clean").where("img < 4").persist()
    configs = [{"method": "bm3d_vst", "strength": s, "radius": 4} for s in (1.0, 2.7)] + [{"method": "bilateral_vst"}]
    run = lambda images, c, at: sorted(map(tuple, runner.run(images, 16, 16, 0.002, 0.00005, c, at).collect()))
    state = str(tmp_path / "results")
    some = run(pairs.where("img < 3"), configs[:1] + configs[2:], state)
    assert len(some) == 4
    written = {p.name for p in (tmp_path / "results").glob("*.parquet")}
    whole = run(pairs, configs, state)
    assert len(whole) == 9 and set(some) <= set(whole)
    assert written <= {p.name for p in (tmp_path / "results").glob("*.parquet")}
    files = sorted(p.name for p in (tmp_path / "results").glob("*.parquet"))
    assert run(pairs, configs, state) == whole and files == sorted(p.name for p in (tmp_path / "results").glob("*.parquet"))
    alone = denoise.bm3d_vst(pairs.select("img", "y", "x", "v"), 16, 16, 0.002, 0.00005, radius=4).join(pairs.withColumnRenamed("v", "n"), ["img", "y", "x"])
    error = {r["img"]: r["m"] for r in alone.groupBy("img").agg(F.avg((F.col("v") - (F.col("clean") - 240) / 3855.0) ** 2).alias("m")).collect()}
    for method, config, img, _, psnr in whole:
        if "2.7" in config:
            assert psnr == pytest.approx(-10 * np.log10(error[img]), abs=1e-9)
