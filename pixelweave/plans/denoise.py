"""Patch-group denoising pipelines, composed of the operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import kernels, scalars
from pixelweave.operators import blocks, knn, layout, match, stencil
from pixelweave.operators.tiles import TILE, Tile, per_tile

PATCH, STRIDE, RADIUS, TOP, LAMBDA = 8, 4, 19, 8, 2.7


def patch_rows(df: DataFrame, height: int, width: int, patch: int) -> DataFrame:
    """Pixels of all patches, (img, y, x, i, j, v)."""
    every = match.patches(df, height, width, patch).select("img", "y", "x", F.posexplode("p").alias("at", "v"))
    return every.select("img", "y", "x", F.floor(F.col("at") / patch).cast("int").alias("i"), (F.col("at") % patch).alias("j"), "v")


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and weights of tiles, with the unfiltered v in a pixel's own tile, to one value a pixel: the seams' only shuffle."""
    sums = parts.groupBy(*keys, "y", "x").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.max("v").alias("v"))
    return sums.select(*keys, "y", "x", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("v")).alias("v"))


def block_filter(
    df: DataFrame, height: int, width: int, *, patch: int = PATCH, stride: int = STRIDE, radius: int = RADIUS, k: int = TOP, channels: int = 1,
    frames: tuple[int, ...] = (0,), noise: tuple[float, float] | None = None, strengths: tuple[float, ...] = (LAMBDA,), tile: int = TILE,
) -> DataFrame:
    """Match on a guide, filter each reference's group, and aggregate: images (img, [t, ch,] y, x, v, raw) to (img, [ch,] y, x, v).

    A tile blurs its integer guide, searches, transforms its groups as matrices and adds them up on
    its array and halo. Two shuffles in all: pixels to tiles, and sums to pixels. Groups without a
    member besides the reference are skipped; pixels that no group covers keep their value. With
    `noise` (gain, variance) a group's threshold follows the mean of its reference patch. Several
    `strengths` of the threshold share a search; a column `variant` then numbers them from 0.
    """
    margin, line = 2, np.array([math.comb(4, i) for i in range(5)])
    names = [*(["variant"] if len(strengths) > 1 else []), "img", *(["ch"] if channels > 1 else [])]

    def work(at: Tile) -> dict[str, np.ndarray]:
        guides = {}
        for t, planes in at.planes.items():
            blur = blocks.blurred(at.mirrored(planes[channels:], "reflect101"), line)
            guides[t] = np.rint(np.pad(blur, ((0, 0), (margin, margin), (margin, margin)))).astype(np.int64)
        ts = [t for t in frames if t in at.planes]
        stack = np.stack([at.planes[t][:channels] for t in ts])
        rows, cols = at.corners(stride, patch)
        found, variance = bool(len(rows) and len(cols)), None
        if found:
            ok, _, t, y, x = blocks.nearest(guides[0], [(t, guides[t]) for t in ts], rows, cols, at.corner_range(patch), patch=patch, radius=radius, k=k)
            ref = np.stack(np.meshgrid(rows, cols, indexing="ij"), -1).reshape(-1, 2)
            y, x, t = np.hstack([ref[:, :1], y]), np.hstack([ref[:, 1:], x]), np.hstack([np.zeros_like(ref[:, :1]), t])
            if noise:
                mean = blocks.box_sums(stack[ts.index(0), 0], rows, cols, patch).ravel() / patch**2
                variance = np.maximum(noise[0] * mean + noise[1], 1e-12)
        mine = np.zeros(stack.shape, bool)
        top, bottom, left, right = at.own
        mine[ts.index(0), :, top:bottom, left:right] = True
        parts = []
        for n, strength in enumerate(strengths):
            num, den = np.zeros(stack.shape), np.zeros(stack.shape)
            if found:
                limit = strength * np.sqrt(variance) if noise else strength
                num, den = blocks.group_filter(stack, np.searchsorted(ts, t), y, x, 1 + ok.sum(1), patch=patch, kind="dct", limit=limit, variance=variance)
            f, ch, cy, cx = cells = np.nonzero(mine | (den > 0))
            parts.append((np.full(len(f), n), np.array(ts)[f], ch, cy + at.y0, cx + at.x0, num[cells], den[cells], np.where(mine, stack, -np.inf)[cells]))
        return dict(zip(("variant", "t", "ch", "y", "x", "num", "den", "v"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    columns = "variant int, t int, ch int, y int, x int, num double, den double, v double"
    parts = per_tile(
        df, ["img"], height, width, work, columns, tile=tile, before=radius + margin, after=radius + patch - 1 + margin, channels=channels, value=("v", "raw"),
    )
    return merged(parts.withColumn("img", (F.col("img") + F.col("t")).cast(df.schema["img"].dataType)), names)


def _stable(raw: DataFrame, a: float, b: float) -> DataFrame:
    """The raster with its stabilized values as v, and as raw what it was."""
    return raw.withColumns({"raw": F.col("v"), "v": scalars.vst(scalars.normalized(F.col("v")), a, b)})


def bm3d_vst(raw: DataFrame, height: int, width: int, a: float, b: float, **search: int) -> DataFrame:
    """Normalize, stabilize, match on a blurred guide, filter groups, invert, clip."""
    out = block_filter(_stable(raw, a, b), height, width, **search)
    return out.withColumn("v", scalars.clip(scalars.vst_inverse(F.col("v"), a, b), 0.0, 1.0))


def bm3d_plain(raw: DataFrame, height: int, width: int, a: float, b: float, **search: int) -> DataFrame:
    """The same without stabilization: each group's threshold follows the mean of its reference patch."""
    noisy = raw.withColumns({"raw": F.col("v"), "v": scalars.normalized(F.col("v"))})
    return block_filter(noisy, height, width, noise=(a, b), **search).withColumn("v", scalars.clip(F.col("v"), 0.0, 1.0))


def vbm3d(raw: DataFrame, height: int, width: int, a: float, b: float, *, frames: int = 1, **search: int) -> DataFrame:
    """Video: groups reach one frame back and one ahead, and all their members are written back."""
    every = match.around(_stable(raw, a, b), frames)
    out = block_filter(every, height, width, frames=tuple(range(-frames, frames + 1)), **search)
    return out.withColumn("v", scalars.clip(scalars.vst_inverse(F.col("v"), a, b), 0.0, 1.0))


def bm3d_packed(raw: DataFrame, height: int, width: int, a: float, b: float, **search: int) -> DataFrame:
    """Mosaic: one search on the summed distance of the four channels; they share groups and a group's mean weight."""
    out = block_filter(_stable(layout.pack_bayer(raw), a, b), height // 2, width // 2, channels=4, **{"k": 16} | search)
    return layout.unpack_bayer(out.withColumn("v", scalars.clip(scalars.gat_inverse(F.col("v"), a, b**0.5), 0.0, 1.0)))


def collaborative_mean(df: DataFrame, matches: DataFrame, patch: int) -> DataFrame:
    """The mean of the matched patches' middle pixels, for each reference."""
    r = patch // 2
    center = df.select("img", (F.col("y") - r).alias("y"), (F.col("x") - r).alias("x"), "v")
    return matches.join(center, ["img", "y", "x"]).groupBy("img", "ref_y", "ref_x").agg(F.avg("v").alias("v"))


def nlm_vst(raw: DataFrame, height: int, width: int, a: float, b: float) -> DataFrame:
    """Non-local means on stabilized values."""
    noisy = raw.withColumn("v", scalars.vst(scalars.normalized(F.col("v")), a, b))
    out = stencil.nlm_uniform(noisy, height, width, h=1.15, patch_r=2, window_r=6, sigma=1.0)
    return out.withColumn("v", scalars.clip(scalars.vst_inverse(F.col("v"), a, b), 0.0, 1.0))


def bilateral_vst(raw: DataFrame, height: int, width: int, a: float, b: float) -> DataFrame:
    """Bilateral filter on stabilized values."""
    noisy = raw.withColumn("v", scalars.vst(scalars.normalized(F.col("v")), a, b))
    out = stencil.circular_bilateral(noisy, height, width, 4, 2.0, 9.0)
    return out.withColumn("v", scalars.clip(scalars.vst_inverse(F.col("v"), a, b), 0.0, 1.0))


def developed(raw: DataFrame, height: int, width: int, pattern: str = "GBRG") -> DataFrame:
    """Sensor mosaic to eight-bit sRGB: normalize, demosaic, balance, correct, curve, quantize."""
    rgb = stencil.demosaic(raw.withColumn("v", scalars.normalized(F.col("v"))), height, width, pattern)
    r, g, b = scalars.color_corrected(*scalars.balanced(F.col("r"), F.col("g"), F.col("b")))
    return rgb.select("img", "y", "x", *(scalars.quantized_u8(F.round(scalars.srgb(v), 9) * 255.0).alias(c) for c, v in (("r", r), ("g", g), ("b", b))))


def search_filter(
    df: DataFrame, keys: list[str], height: int, width: int, *, patch: int, step: int, channels: int = 1, guide: str = "first", blur: tuple[int, float] = (2, 1.5),
    k: int = 7, k_before: int = 3, radius: int = 4, size: int = 8, turns: int = 2, tile: int = 83, overlap: int = 19, seed: int = 42,
    measure: str = "ssd", cut: float = 0.0, kind: str = "haar", noise: tuple[float, float] | None = None,
) -> DataFrame:
    """Randomized search and collaborative filtering in overlapping tiles: rasters (keys, [t, ch,] y, x, v) to (keys, ch, y, x, v).

    A tile searches on a blurred guide: its first channel, the mean of the channels, or all of them
    jointly. Where a frame before (t = 1) is there, its `k_before` nearest patches within `radius`
    compete with the spatial ones; the best size - 1 and the reference make a group, filled up with
    the reference. Only this frame's members are written; tiles meet in their mean. The `measure` of
    patches may be that of their DCT coefficients from `cut` on; `kind` is the transform along a group.
    With `noise` (gain, variance) a group's threshold follows the mean of its reference patch.
    """
    r, (reach, sigma) = patch // 2, blur
    line, win = blocks.gaussian_line(reach, sigma) if reach else np.ones(1), np.zeros((patch, patch))
    for i, j, w in kernels.kaiser(patch):
        win[i, j] = w

    def work(at: Tile) -> dict[str, np.ndarray]:
        ts = sorted(at.planes)
        stack = np.stack([at.inside(at.planes[t]) for t in ts])
        soft = np.stack([blocks.blurred(at.mirrored(at.planes[t], "reflect101"), line) for t in ts])
        soft = {"first": soft[:, :1], "mean": soft.mean(1, keepdims=True), "joint": soft}[guide]
        out = stack[0].copy()
        if min(stack.shape[2:]) >= patch:
            found = knn.Search(soft[0], k=k, patch=patch, step=step, seed=seed, origin=(at.y0 + reach, at.x0 + reach), measure=measure, limit=cut)
            found.run(turns)
            dist, dy, dx = (c.reshape(-1, k) for c in (found.dist, found.dy, found.dx))
            dist = np.where((dy == 0) & (dx == 0), np.inf, dist)  # the reference is a member as it is
            t = np.zeros(dist.shape, int)
            y, x = (c.reshape(-1, 1) - r for c in np.meshgrid(found.rows, found.cols, indexing="ij"))
            if len(ts) > 1:
                edge = ((0, 0), (radius, radius), (radius, radius))
                now, then = (np.pad(soft[f], edge) for f in (0, 1))
                fits = (radius, radius + stack.shape[2] - patch, radius, radius + stack.shape[3] - patch)
                ok, d2, t2, y2, x2 = blocks.nearest(now, [(1, then)], found.rows - r + radius, found.cols - r + radius, fits, patch=patch, radius=radius, k=k_before)
                dist, t = np.hstack([np.where(ok, d2, np.inf), dist]), np.hstack([t2, t])
                dy, dx = np.hstack([y2 - radius - y, dy]), np.hstack([x2 - radius - x, dx])
            order = np.argsort(dist, axis=1, kind="stable")[:, : size - 1]  # of equal ones the frame before wins
            dist, t, dy, dx = (np.take_along_axis(c, order, 1) for c in (dist, t, dy, dx))
            t, dy, dx = (np.where(np.isfinite(dist), c, 0) for c in (t, dy, dx))
            t, dy, dx = (np.hstack([np.zeros((len(c), 1), int), c, np.zeros((len(c), size - 1 - c.shape[1]), int)]) for c in (t, dy, dx))
            limit, variance = LAMBDA, None
            if noise:
                mean = blocks.box_sums(stack[0, 0], found.rows - r, found.cols - r, patch).ravel() / patch**2
                variance = np.maximum(noise[0] * mean + noise[1], 1e-12)
                limit = LAMBDA * np.sqrt(variance)
            num, den = blocks.group_filter(stack, t, y + dy, x + dx, np.full(len(t), size), patch=patch, kind=kind, limit=limit, variance=variance, window=win, only=0)
            out = np.divide(num[0], den[0], out=out, where=den[0] > 0)
        y, x = at.own_cells()
        return {"ch": np.repeat(np.arange(channels), len(y)), "y": np.tile(y, channels), "x": np.tile(x, channels), "v": out.ravel()}

    each = per_tile(df, keys, height, width, work, "ch int, y int, x int, v double", tile=tile, overlap=overlap, before=reach, after=reach, channels=channels)
    return layout.merge_tiles(each, (*keys, "ch", "y", "x"))


def _destabilized(df: DataFrame, a: float, b: float) -> DataFrame:
    return df.withColumn("v", scalars.clip(scalars.gat_inverse(F.col("v"), a, b**0.5), 0.0, 1.0))


def aknn_bm3d(raw: DataFrame, height: int, width: int, a: float, b: float, *, patch: int = 5, step: int = 2, tile: int = 24, overlap: int = 8) -> DataFrame:
    """Randomized search on the blurred, stabilized image; Haar transform over each group; Kaiser-weighted aggregation."""
    noisy = raw.withColumn("v", scalars.vst(scalars.normalized(F.col("v")), a, b))
    return _destabilized(search_filter(noisy, ["img"], height, width, patch=patch, step=step, tile=tile, overlap=overlap), a, b).drop("ch")


def aknn_plain(
    raw: DataFrame, height: int, width: int, a: float, b: float, *, guided: bool = True, patch: int = 5, step: int = 2, tile: int = 24, overlap: int = 8,
) -> DataFrame:
    """Without stabilization: thresholds by the local variance, a DCT along the group.

    Guided, the search goes on a blurred image; else on the thresholded DCT coefficients of the noisy patches.
    """
    noisy = raw.withColumn("v", scalars.normalized(F.col("v")))
    way = {"blur": (2, 1.5)} if guided else {"blur": (0, 1.0), "measure": "dct", "cut": LAMBDA * (a * 0.5 + b) ** 0.5}
    out = search_filter(noisy, ["img"], height, width, patch=patch, step=step, tile=tile, overlap=overlap, kind="dct", noise=(a, b), **way)
    return out.withColumn("v", scalars.clip(F.col("v"), 0.0, 1.0)).drop("ch")


def aknn_bm3d_raw(raw: DataFrame, height: int, width: int, a: float, b: float, *, patch: int = 3, step: int = 1, guide: str = "joint", tile: int = 12, overlap: int = 4) -> DataFrame:
    """The same on a mosaic: one search serves the four channels, jointly on all of them or on one guide."""
    packed = layout.pack_bayer(raw).withColumn("v", scalars.vst(scalars.normalized(F.col("v")), a, b))
    out = search_filter(packed, ["img"], height // 2, width // 2, patch=patch, step=step, channels=4, guide=guide, blur=(1, 0.8), tile=tile, overlap=overlap)
    return layout.unpack_bayer(_destabilized(out, a, b))
