"""Stencil filters. A tile gets its halo in one shuffle; each offset of the stencil is then one shifted array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from pixelweave.functions import kernels
from pixelweave.operators import blocks
from pixelweave.operators.tiles import Tile, per_tile, raster

Weight = Callable[[np.ndarray, int, int], np.ndarray]


def _stencil(df: DataFrame, height: int, width: int, margin: int, border: str, work: Callable[[np.ndarray], np.ndarray], value: str = "v") -> DataFrame:
    """Apply a function from a tile with its margin to the tile, to every image (img, y, x, v)."""

    def run(at: Tile) -> dict[str, np.ndarray]:
        y, x = at.own_cells()
        return {"y": y, "x": x, "v": work(at.mirrored(at.planes[0][0], border).astype(float)).ravel()}

    return per_tile(df, ["img"], height, width, run, "y int, x int, v double", before=margin, after=margin, value=value)


def correlate(df: DataFrame, height: int, width: int, kernel: list[tuple], border: str, value: str = "v") -> DataFrame:
    """Weighted sum of the neighbours, by the kernel."""
    r = max(max(abs(dy), abs(dx)) for dy, dx, _ in kernel)
    return _stencil(df, height, width, r, border, lambda a: blocks.correlate(a, kernel, r), value)


def separable_gaussian(df: DataFrame, height: int, width: int, radius: int, sigma: float, border: str = "reflect101") -> DataFrame:
    """The Gaussian in two passes of one dimension."""
    line = blocks.gaussian_line(radius, sigma)
    return _stencil(df, height, width, radius, border, lambda a: blocks.blurred(a, line))


def _weighted(df: DataFrame, height: int, width: int, offsets: list[tuple[int, int]], border: str, weight: Weight) -> DataFrame:
    """Mean of the neighbours, each weighted by a function of its difference and offset."""
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)

    def mean(a: np.ndarray) -> np.ndarray:
        middle = blocks.shifted(a, 0, 0, r)
        num, den = np.zeros(middle.shape), np.zeros(middle.shape)
        for dy, dx in offsets:
            near = blocks.shifted(a, dy, dx, r)
            w = weight(near - middle, dy, dx)
            num += w * near
            den += w
        return num / den

    return _stencil(df, height, width, r, border, mean)


def yaroslavsky(df: DataFrame, height: int, width: int, rho: int, h: float) -> DataFrame:
    """Mean of a window, weighted by exp(-difference^2 / h^2)."""
    return _weighted(df, height, width, kernels.box(rho), "reflect", lambda d, dy, dx: np.exp(-(d * d) / (h * h)))


def bilateral(df: DataFrame, height: int, width: int, rho: int, h: float, s: float) -> DataFrame:
    """The same, with a weight exp(-distance^2 / s^2) too."""
    weight = lambda d, dy, dx: np.exp(-(d * d) / (h * h)) * np.exp(-(dy * dy + dx * dx) / (s * s))
    return _weighted(df, height, width, kernels.box(rho), "reflect", weight)


def circular_bilateral(df: DataFrame, height: int, width: int, radius: int, color: float, space: float) -> DataFrame:
    """Bilateral filter on a disc, with factors of a half in both exponents, border without repeated edge."""
    disc = [(y, x) for y, x in kernels.box(radius) if y * y + x * x <= radius * radius]
    weight = lambda d, dy, dx: np.exp(-(d * d) / (2 * color * color)) * np.exp(-(dy * dy + dx * dx) / (2 * space * space))
    return _weighted(df, height, width, disc, "reflect101", weight)


def nlm_uniform(df: DataFrame, height: int, width: int, *, h: float, patch_r: int, window_r: int, sigma: float) -> DataFrame:
    """Non-local means with uniform patches and a symmetric window that goes on beyond the border.

    The mean squared difference loses the noise's share, 2 sigma^2; patches further apart than five h^2 don't count.
    """
    margin, line = window_r + patch_r, blocks.gaussian_line(patch_r, 0)

    def mean(a: np.ndarray) -> np.ndarray:
        wide = blocks.shifted(a, 0, 0, window_r)
        num, den = (np.zeros(blocks.shifted(a, 0, 0, margin).shape) for _ in range(2))
        for dy, dx in kernels.box(window_r):
            d = blocks.shifted(a, dy, dx, window_r) - wide
            apart = np.maximum(blocks.blurred(d * d, line) - 2.0 * sigma * sigma, 0.0) / (h * h)
            w = np.where(apart <= 5, np.exp(-apart), 0.0)
            num += w * blocks.shifted(a, dy, dx, margin)
            den += w
        return num / den

    return _stencil(df, height, width, margin, "reflect101", mean)


def nlm(df: DataFrame, height: int, width: int, *, h: float, patch_r: int, window_r: int, sigma: float) -> DataFrame:
    """Non-local means. The window leaves out its last row and column and ends at the border; the patch distance is weighted by a Gaussian.

    The weighted distance of all patches at one offset is one blur of the squared differences.
    """
    margin, line = window_r + patch_r, blocks.gaussian_line(patch_r, sigma)

    def run(at: Tile) -> dict[str, np.ndarray]:
        a = at.mirrored(at.planes[0][0], "reflect101").astype(float)
        wide, (y, x) = blocks.shifted(a, 0, 0, window_r), at.own_cells()
        shape = blocks.shifted(a, 0, 0, margin).shape
        y, x = y.reshape(shape), x.reshape(shape)
        num, den = np.zeros(shape), np.zeros(shape)
        for dy, dx in kernels.box(window_r, half_open=True):
            d = blocks.shifted(a, dy, dx, window_r) - wide
            there = (y + dy >= 0) & (y + dy < height) & (x + dx >= 0) & (x + dx < width)
            w = np.where(there, np.exp(-blocks.blurred(d * d, line) / (h * h)), 0.0)
            num += w * blocks.shifted(a, dy, dx, margin)
            den += w
        return {"y": y.ravel(), "x": x.ravel(), "v": (num / den).ravel()}

    return per_tile(df, ["img"], height, width, run, "y int, x int, v double", before=margin, after=margin)


def demosaic(df: DataFrame, height: int, width: int, pattern: str) -> DataFrame:
    """Bilinear colors of a mosaic (img, y, x, r, g, b): the mean of the nearest samples of each color.

    `pattern` names the colors of the top-left 2 x 2 cells, row by row.
    """

    def run(at: Tile) -> dict[str, np.ndarray]:
        a = at.mirrored(at.planes[0][0], "reflect101").astype(float)
        y, x = at.own_cells()
        shape = blocks.shifted(a, 0, 0, 1).shape
        y, x = y.reshape(shape), x.reshape(shape)
        names = np.array(list(pattern))
        own, out = names[y % 2 * 2 + x % 2], {"y": y.ravel(), "x": x.ravel()}
        for c in "RGB":
            total, count = np.zeros(shape), np.zeros(shape)
            for dy, dx in kernels.box(1):
                middle, cross = dy == dx == 0, dy == 0 or dx == 0
                wanted = np.where(own == c, middle, (cross and not middle) if c == "G" else not middle)
                hit = wanted & (names[(y + dy) % 2 * 2 + (x + dx) % 2] == c)
                total += np.where(hit, blocks.shifted(a, dy, dx, 1), 0.0)
                count += hit
            out[c.lower()] = (total / count).ravel()
        return out

    return per_tile(df, ["img"], height, width, run, "y int, x int, r double, g double, b double", before=1, after=1)


def window_means(df: DataFrame, height: int, width: int, radius: int) -> DataFrame:
    """Means of a, b, a², b² and ab over each window that lies inside the raster: (img, y, x, ma, mb, aa, bb, ab), by two channels."""
    line = blocks.gaussian_line(radius, 0)

    def run(at: Tile) -> dict[str, np.ndarray]:
        a, b = at.planes[0]
        y, x = at.own_cells()
        ok = (y >= radius) & (y < height - radius) & (x >= radius) & (x < width - radius)
        means = {n: blocks.blurred(v, line).ravel()[ok] for n, v in (("ma", a), ("mb", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))}
        return {"y": y[ok], "x": x[ok], **means}

    return per_tile(df, ["img"], height, width, run, "y int, x int, ma double, mb double, aa double, bb double, ab double", before=radius, after=radius, channels=2)
