"""Tiles, searches and recursion: seams, starts, gaps and restarts."""

import numpy as np
import pytest

from pixelweave.operators import blocks, knn, match, stencil
from pixelweave.plans import denoise, video
from pixelweave.sources import rasters
from tests.conftest import SF


@pytest.fixture(scope="module")
def raw(spark):
    return rasters.raw32(spark, SF).persist()


def rows(df, *order):
    return sorted(map(tuple, df.collect()), key=lambda r: r[: len(order)] if order else r)


def array(df, h, w, value="v"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def test_matches_do_not_depend_on_tiles(raw):
    one, many = (rows(match.match(raw, 32, 32, patch=5, stride=3, radius=7, k=6, tile=t)) for t in (64, 10))
    assert one == many and len(one) == 100 * 6


def test_matches_of_reals_follow_their_integers(raw):
    halves = raw.withColumn("v", raw["v"] / 2)
    whole, real = (rows(match.match(d, 32, 32, patch=4, stride=4, radius=5, k=4, tile=16)) for d in (raw, halves))
    assert [r[:4] + r[5:] for r in whole] == [r[:4] + r[5:] for r in real]
    assert [r[4] for r in whole] == [4 * r[4] for r in real]


def test_filters_do_not_depend_on_tiles(raw):
    for f in (
        lambda t: denoise.bm3d_vst(raw, 32, 32, 0.002, 0.00005, tile=t),
        lambda t: denoise.vbm3d(raw.unionByName(raw.selectExpr("2 img", "y", "x", "v + 5 v")), 32, 32, 0.002, 0.00005, tile=t, radius=6),
        lambda t: denoise.bm3d_packed(raw, 32, 32, 0.002, 0.00005, tile=t, k=4),
    ):
        one, many = rows(f(64)), rows(f(12))
        assert [r[:3] for r in one] == [r[:3] for r in many]
        np.testing.assert_allclose([r[3] for r in one], [r[3] for r in many], rtol=0, atol=1e-9)


def test_stencils_at_seams(raw, monkeypatch):
    whole = array(stencil.nlm(raw, 32, 32, h=150.0, patch_r=1, window_r=4, sigma=1.0), 32, 32)
    monkeypatch.setattr(stencil.per_tile, "__kwdefaults__", {**stencil.per_tile.__kwdefaults__, "tile": 9})
    np.testing.assert_allclose(array(stencil.nlm(raw, 32, 32, h=150.0, patch_r=1, window_r=4, sigma=1.0), 32, 32), whole, rtol=0, atol=1e-9)


def test_bilateral_by_hand(raw):
    a = array(raw, 32, 32)
    wide = np.pad(a, 7, "symmetric")
    num, den = np.zeros(a.shape), np.zeros(a.shape)
    for dy in range(-7, 8):
        for dx in range(-7, 8):
            near = wide[7 + dy : 39 + dy, 7 + dx : 39 + dx]
            w = np.exp(-((near - a) ** 2) / 480.0**2 - (dy * dy + dx * dx) / 16.0)
            num, den = num + w * near, den + w
    np.testing.assert_allclose(array(stencil.bilateral(raw, 32, 32, 7, 480.0, 4.0), 32, 32), num / den, rtol=0, atol=1e-8)


def test_groups_of_any_size_come_back():
    """Without a threshold the filter gives every patch back, whatever the transform and the group's size."""
    r = np.random.default_rng(1)
    stack = r.normal(size=(2, 3, 20, 20))
    n = 40
    t, y, x = r.integers(0, 2, (n, 9)), r.integers(0, 15, (n, 9)), r.integers(0, 15, (n, 9))
    for kind in ("dct", "haar"):
        num, den = blocks.group_filter(stack, t, y, x, r.integers(1, 10, n), patch=5, kind=kind, limit=0.0)
        np.testing.assert_allclose(num[den > 0] / den[den > 0], stack[den > 0], atol=1e-9)


def test_channels_share_a_mean_weight():
    """Two channels with different numbers of large coefficients get one weight, the mean of theirs."""
    stack = np.zeros((1, 2, 4, 8))
    stack[0, 0] = 100.0  # one coefficient is left in this channel
    stack[0, 1] = np.random.default_rng(2).normal(0, 100, (4, 8))
    at = np.zeros((1, 2), int)
    _, den = blocks.group_filter(stack, at, at, np.array([[0, 4]]), np.array([2]), patch=4, kind="dct", limit=1e-6)
    assert np.allclose(den, (1 + 1 / 32) / 2)


@pytest.mark.parametrize("kind", knn.STARTS)
def test_starts_are_valid_and_reproducible(raw, kind):
    window = 8 if kind == "window" else None
    found = knn.aknn(raw, 32, 32, k=6, patch=5, step=2, turns=0, window=window, start=kind, apart=False, tile=20, overlap=6)
    got = rows(found)
    assert got == rows(knn.aknn(raw.repartition(5), 32, 32, k=6, patch=5, step=2, turns=0, window=window, start=kind, apart=False, tile=20, overlap=6))
    places = [(r[1], r[2], r[5], r[6]) for r in got]
    assert len(set(places)) == len(places)
    for _, y, x, _, _, dy, dx in got:
        assert 2 <= y + dy < 30 and 2 <= x + dx < 30
        if kind == "window":
            assert (dy, dx) != (0, 0) and max(abs(dy), abs(dx)) <= 4
    if kind == "window":  # the window always holds enough places
        assert len(got) == 14 * 14 * 6


def test_scan_by_diagonals_is_the_scan():
    """Propagation by anti-diagonals gives what one center after the other gives."""
    a = np.random.default_rng(7).normal(size=(1, 18, 22))
    fast, slow = (knn.Search(a, k=3, patch=3, step=2, seed=1, apart=False) for _ in range(2))
    fast.start()
    slow.start()
    for turn in (0, 1):
        fast.propagate(turn)
        m, n = slow.place.shape
        by = 1 if turn else -1
        for i in range(m)[:: -by]:
            for j in range(n)[:: -by]:
                slow._take_over(np.array([i]), np.array([j]), by, slow.k)
    assert (fast.dist == slow.dist).all() and (fast.dy == slow.dy).all() and (fast.dx == slow.dx).all()


def test_searches_find_repeated_patches(spark):
    """In a raster of period eight, both searches find exact copies nearly everywhere."""
    raw = spark.range(32 * 32).selectExpr("0 img", "cast(id div 32 as int) y", "cast(id % 32 as int) x", "cast(hash(id div 32 % 8, id % 8) % 1000 as int) v")
    for best_only in (False, True):
        found = knn.aknn(raw, 32, 32, k=3, patch=5, step=1, turns=4, window=24, start="window", measure="sad", best_only=best_only, apart=False, tile=32, overlap=0)
        best = found.where("k = 1").toPandas()
        assert (best["dist"] == 0).mean() > 0.9


def clips(spark, frames, value="1000 + 7 * y"):
    return spark.createDataFrame([(s, f) for s, n in frames.items() for f in n], "seq int, frame int").crossJoin(spark.range(144).selectExpr("cast(id div 12 as int) y", "cast(id % 12 as int) x")).selectExpr("*", f"cast({value} as int) v")


def test_recursion_keeps_order_and_skips_gaps(spark):
    frames = {0: [1, 2, 5], 1: [3], 2: [2, 9, 10, 40]}
    steps = {(r["seq"], r["frame"]): (r["step"], r["before"]) for r in video.numbered(clips(spark, frames), ["seq"]).collect()}
    assert steps[0, 5] == (3, 2) and steps[2, 40] == (4, 10) and steps[1, 3] == (1, None)
    flat = clips(spark, frames, "1500")
    out = video.recursive(flat, ["seq"], 12, 12, 0.002, 0.00005, patch=5, step=2, tile=8, overlap=2).toPandas()
    assert sorted(out.groupby(["seq", "frame"]).size().to_dict().items()) == [((s, f), 144) for s, n in frames.items() for f in n]
    assert np.ptp(out["v"]) < 1e-9  # flat frames stay flat through the whole recursion


def test_recursion_uses_the_frame_before(spark):
    noise = "1500 + hash(seq, frame, y, x) % 200"
    both = clips(spark, {0: [1, 2, 3]}, noise)
    last = video.recursive(both, ["seq"], 12, 12, 0.002, 0.00005, patch=5, step=1, tile=12, overlap=0).where("frame = 3")
    alone = video.recursive(both.where("frame = 3"), ["seq"], 12, 12, 0.002, 0.00005, patch=5, step=1, tile=12, overlap=0)
    level = (1500 - 240) / 3855
    error = [float(np.nanmean((array(d, 12, 12) - level) ** 2)) for d in (last, alone)]
    assert error[0] != error[1]
    assert error[0] < float(np.mean((array(both.where("frame = 3"), 12, 12) - 1500) ** 2)) / 3855**2


def test_recursion_goes_on_after_a_restart(spark, tmp_path):
    frames = clips(spark, {0: [1, 2, 4], 1: [2, 3]}, "1500 + hash(seq, frame, y, x) % 200")
    run = lambda df, state: rows(video.recursive(df, ["seq"], 12, 12, 0.002, 0.00005, patch=5, step=2, tile=12, overlap=0, state=state))
    whole = run(frames, None)
    state = str(tmp_path / "state")
    run(frames.where("frame < 4"), state)
    kept = (tmp_path / "state" / "filtered-2" / "_SUCCESS").stat().st_mtime_ns
    assert run(frames, state) == whole
    assert (tmp_path / "state" / "filtered-2" / "_SUCCESS").stat().st_mtime_ns == kept


def test_recursion_of_nothing(spark):
    assert video.recursive(clips(spark, {0: [1]}).where("false"), ["seq"], 12, 12, 0.002, 0.00005, patch=5, step=2).count() == 0


def test_temporal_matches_find_a_shift(spark):
    """A frame that moved by (1, 2) while frames were missing is found there, in the last frame that exists."""
    moved = spark.createDataFrame([(0, 1, 0, 0), (0, 6, 1, 2)], "seq int, frame int, sy int, sx int").crossJoin(spark.range(400).selectExpr("cast(id div 20 as int) y", "cast(id % 20 as int) x"))
    moved = moved.selectExpr("seq", "frame", "y", "x", "cast(hash(y + sy, x + sx) % 1000 as int) v")
    found = video.temporal_matches(moved, ["seq"], 20, 20, patch=5, stride=3).where("rk = 1 and ref_y < 14 and ref_x < 13").collect()
    assert found and all((r["before"], r["dist"], r["y"] - r["ref_y"], r["x"] - r["ref_x"]) == (1, 0, 1, 2) for r in found)


def test_groups_as_arrays(raw):
    found = match.match(raw, 32, 32, patch=4, stride=14, radius=5, k=3)
    a = array(raw, 32, 32)
    groups = match.group_arrays(raw, found, 32, 32, 4).collect()
    best = {}
    for r in found.collect():
        best.setdefault((r["ref_y"], r["ref_x"]), {})[r["rk"]] = (r["img"], r["y"], r["x"])
    assert len(groups) == 9
    for g in groups:
        own = [(0, g["ref_y"], g["ref_x"]), *(best[g["ref_y"], g["ref_x"]][k] for k in (1, 2, 3))]
        assert [tuple(m) for m in g["members"]] == own
        assert g["patches"] == [a[y : y + 4, x : x + 4].ravel().tolist() for _, y, x in own]


def test_unstabilized_search_filters(spark):
    """A flat image comes back; a noisy one gets nearer to it, whichever way patches are searched."""
    flat = spark.range(576).selectExpr("0 img", "cast(id div 24 as int) y", "cast(id % 24 as int) x", "1500 v")
    noisy = flat.withColumn("v", noise_of())
    level = (1500 - 240) / 3855
    for guided in (True, False):
        out = lambda d: array(denoise.aknn_plain(d, 24, 24, 0.0, 2e-4, guided=guided, tile=16, overlap=6), 24, 24)  # noqa: B023, E731
        assert np.ptp(out(flat)) < 1e-9
        before = np.mean(((array(noisy, 24, 24) - 240) / 3855 - level) ** 2)
        assert np.mean((out(noisy) - level) ** 2) < 0.5 * before


def noise_of():
    from pyspark.sql import functions as F

    from pixelweave.functions import streams

    return (F.lit(1500) + F.round(streams.normal(F.col("y") * 24 + F.col("x"), 3) * 54)).cast("int")
