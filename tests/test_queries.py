"""Registered queries against their SQL twins, and invariants of those without one."""

import duckdb
import numpy as np
import pytest

from pixelweave.operators import metrics
from pixelweave.oracles import ORACLE_SQL
from pixelweave.plans import denoise
from pixelweave.queries import QUERIES
from pixelweave.sources import files, sinks
from pixelweave.streaming import append
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    for c in cols:
        if got[c].dtype == object:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
        else:
            np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=0, atol=1e-6)


def test_haar_of_incomplete_groups(spark, tmp_path):
    """Groups of one, two, three and four vectors come back with their own members only."""
    rows = [(i, [0.1 * i - 0.7, 0.01 * i * i + 0.3]) for i in (0, 1, 2, 3, 4, 7, 10, 13, 15, 16, 19, 20, 22, 23, 24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["haar5_round_trip"](spark, str(tmp_path)).select("g", "x", "k", "v").collect()))
    assert got == sorted(c.execute(f"select g, x, k, v from ({ORACLE_SQL['haar5_round_trip']})").fetchall())


def test_search_invariants(spark):
    found = QUERIES["aknn_full"](spark, SF).toPandas()
    assert (found.groupby(["img", "y", "x"]).size() <= 8).all()
    assert not found.duplicated(["img", "y", "x", "dy", "dx"]).any()
    assert found.sort_values(["y", "x", "k"]).groupby(["img", "y", "x"])["dist"].apply(lambda d: d.is_monotonic_increasing).all()


def test_noise_is_reproducible(spark):
    one, two = (QUERIES["noise_awgn"](spark, SF).toPandas().sort_values(["y", "x"]) for _ in range(2))
    assert one["v"].tolist() == two["v"].tolist()
    assert one["v"].between(0, 1).all()


def test_files_of_a_tree(spark, tmp_path):
    for name in ("a/one.TIF", "a/b/two.tiff", "a/b/three.png", "four.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = files.walk(spark, str(tmp_path), "tif", "tiff").collect()
    assert sorted(r["below"] for r in got) == ["a/b/two.tiff", "a/one.TIF", "four.tif"]


def test_results_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(str(k % 3), k % 5, float(k)) for k in range(60)], "method string, frame int, psnr double")
    sinks.write_results(rows, str(tmp_path / "out"), ["method", "frame", "psnr", "ssim"], ["method", "frame", "psnr"])
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert all(p[0] == "method,frame,psnr,ssim" for p in parts if p)
    lines = [tuple(x.split(",")) for p in parts for x in p[1:]]
    assert len(lines) == 60 and lines == sorted(lines, key=lambda x: (x[0], int(x[1]), float(x[2])))


def test_stream_appends_each_row_once(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(source)
        append.append_results(spark.readStream.schema("id long").parquet(source), out, log, once=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 7


def test_summary_skips_nan_and_null(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", None)], "m string, v double")
    assert sorted(map(tuple, metrics.summary(rows, "m", "v").collect())) == [("a", 1.0, 1), ("b", None, 0)]


def test_channels_share_one_weight(spark):
    """A packed mosaic of one value comes back as it is, and every pixel is there once."""
    raw = spark.range(256).selectExpr("0 img", "cast(id div 16 as int) y", "cast(id % 16 as int) x", "1000 v")
    got = denoise.bm3d_packed(raw, 16, 16, 0.002, 0.00005, patch=4, radius=4, k=3).toPandas()
    assert len(got) == 256 and not got.duplicated(["y", "x"]).any()
    assert np.ptp(got["v"]) < 1e-9
