"""Randomized patch search inside tiles: seeded start, propagation and random search.

Propagation follows a scan: a center takes over what the centers above and to its left have just
found. All centers of an anti-diagonal depend on the one before it only, so a scan goes by whole
anti-diagonals of arrays. Random numbers are counted, not drawn in turn: they depend on seed, place,
step and try, and so neither on the tile nor on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import match
from pixelweave.operators.tiles import Tile, per_tile

STARTS = ("normal", "resampled", "doubled", "window")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Search:
    """The k best offsets of each center on a grid, in one tile: arrays dist, dy, dx by (row, column, rank); free ranks have an infinite distance.

    guide: (channel, row, column); distances are summed over the channels. Patches, or their
    thresholded DCT coefficients, are laid out once as a table of vectors.
    """

    def __init__(
        self, guide: np.ndarray, *, k: int, patch: int, step: int, window: int | None = None, seed: int = 42, origin: tuple[int, int] = (0, 0),
        measure: str = "ssd", limit: float = 0.0, apart: bool = True, start: str = "normal",
    ):
        self.k, self.r, self.window, self.measure, self.apart, self.kind = k, patch // 2, window, measure, apart, start
        self.h, self.w = guide.shape[1:]
        views = np.lib.stride_tricks.sliding_window_view(guide.astype(float), (patch, patch), axis=(1, 2))
        if measure == "dct":
            i = np.arange(patch)
            c = np.sqrt(2 / patch) * np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * patch))
            c[0] /= np.sqrt(2)
            views = c @ views @ c.T
            views = np.where(np.abs(views) < limit, 0.0, views)
        self.table = views.transpose(1, 2, 0, 3, 4).reshape(self.h - 2 * self.r, self.w - 2 * self.r, -1)
        self.rows, self.cols = np.arange(self.r, self.h - self.r, step), np.arange(self.r, self.w - self.r, step)
        shape = (len(self.rows), len(self.cols), k)
        self.dist, self.dy, self.dx = np.full(shape, np.inf), np.zeros(shape, int), np.zeros(shape, int)
        y, x = np.meshgrid(self.rows + origin[0], self.cols + origin[1], indexing="ij")
        place = (np.uint64(seed) << np.uint64(48)) ^ (y.astype(np.uint64) << np.uint64(24)) ^ x.astype(np.uint64)
        self.place = _mixed(place + np.uint64(0x9E3779B97F4A7C15))
        self.steps = 0

    def uniform(self, count: int) -> np.ndarray:
        """(row, column, count) numbers in [0, 1), new ones at each call."""
        self.steps += 1
        at = np.uint64(self.steps << 32) + np.arange(count, dtype=np.uint64)
        return (_mixed(self.place[..., None] ^ _mixed(at)) >> np.uint64(11)) / float(1 << 53)

    def normal(self, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """Rounded normal offsets (dy, dx), by Box and Muller."""
        u = self.uniform(2)
        far = spread * np.sqrt(-2.0 * np.log1p(-u[..., 0]))
        turn = 2 * np.pi * u[..., 1]
        return np.rint(far * np.cos(turn)).astype(int), np.rint(far * np.sin(turn)).astype(int)

    def inside(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (y >= self.r) & (y < self.h - self.r) & (x >= self.r) & (x < self.w - self.r)

    def offer(self, i: np.ndarray, j: np.ndarray, dy: np.ndarray, dx: np.ndarray, there: np.ndarray | None = None) -> None:
        """Offer one offset to each of these centers (each named once).

        It is kept if its patch lies inside, isn't almost the same place, isn't known, and is nearer than the last.
        """
        y, x = self.rows[i] + dy, self.cols[j] + dx
        ok = self.inside(y, x) if there is None else there & self.inside(y, x)
        if self.apart:
            ok &= ((dy == 0) & (dx == 0)) | (np.maximum(np.abs(dy), np.abs(dx)) > self.r)
        if self.window is not None:
            ok &= np.maximum(np.abs(dy), np.abs(dx)) <= self.window // 2
        i, j, dy, dx, y, x = (c[ok] for c in (i, j, dy, dx, y, x))
        d = self.table[y - self.r, x - self.r] - self.table[self.rows[i] - self.r, self.cols[j] - self.r]
        dist = (np.abs(d) if self.measure == "sad" else d * d).sum(1)
        known = ((self.dy[i, j] == dy[:, None]) & (self.dx[i, j] == dx[:, None]) & np.isfinite(self.dist[i, j])).any(1)
        take = ~known & (dist < self.dist[i, j, -1])
        i, j = i[take], j[take]
        lists = [np.hstack([own[i, j], new[take, None]]) for own, new in ((self.dist, dist), (self.dy, dy), (self.dx, dx))]
        order = np.argsort(lists[0], axis=1, kind="stable")[:, : self.k]
        for own, of in zip((self.dist, self.dy, self.dx), lists, strict=True):
            own[i, j] = np.take_along_axis(of, order, 1)

    def start(self) -> None:
        """The first offsets of each center, by the kind of start.

        `normal`: k normal offsets, a uniform place where one leaves the tile. `resampled`: up to eight
        more draws before that, three times as wide. `doubled`: as the first, twice as many, as wide.
        `window`: of the offsets in the window, itself excepted, the k that a random order puts first
        and whose patches fit, so none comes twice.
        """
        i, j = (c.ravel() for c in np.indices(self.place.shape))
        if self.kind == "window":
            half = self.window // 2
            steps = np.array([(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if a or b])
            key = self.uniform(len(steps)).reshape(-1, len(steps))
            fits = self.inside(self.rows[i][:, None] + steps[:, 0], self.cols[j][:, None] + steps[:, 1])
            order = np.argsort(np.where(fits, key, 2.0), axis=1, kind="stable")[:, : self.k]
            for n in range(order.shape[1]):
                self.offer(i, j, steps[order[:, n], 0], steps[order[:, n], 1], np.take_along_axis(fits, order[:, n : n + 1], 1)[:, 0])
            return
        spread = self.w / 3 if self.kind != "normal" else (self.window / 2 if self.window else min(self.h, self.w)) / 4
        y, x = self.rows[i], self.cols[j]
        for _ in range(2 * self.k if self.kind == "doubled" else self.k):
            dy, dx = (c.ravel() for c in self.normal(spread))
            for _ in range(8 if self.kind == "resampled" else 0):
                again, out = [c.ravel() for c in self.normal(spread)], ~self.inside(y + dy, x + dx)
                dy, dx = np.where(out, again[0], dy), np.where(out, again[1], dx)
            out, u = ~self.inside(y + dy, x + dx), self.uniform(2).reshape(-1, 2)
            dy = np.where(out, self.r + np.floor(u[:, 0] * (self.h - 2 * self.r)).astype(int) - y, dy)
            dx = np.where(out, self.r + np.floor(u[:, 1] * (self.w - 2 * self.r)).astype(int) - x, dx)
            self.offer(i, j, dy, dx)

    def _diagonals(self, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, n = self.place.shape
        for d in reversed(range(m + n - 1)) if back else range(m + n - 1):
            i = np.arange(max(0, d - n + 1), min(m, d + 1))
            yield i, d - i

    def _take_over(self, i: np.ndarray, j: np.ndarray, by: int, best: int) -> None:
        """Offers from the neighbour rows `by` away, then from the neighbour columns, their `best` first offsets each."""
        for di, dj in ((by, 0), (0, by)):
            ok = (i + di >= 0) & (i + di < self.place.shape[0]) & (j + dj >= 0) & (j + dj < self.place.shape[1])
            ni, nj = i[ok] + di, j[ok] + dj
            for n in range(best):
                self.offer(i[ok], j[ok], self.dy[ni, nj, n], self.dx[ni, nj, n], np.isfinite(self.dist[ni, nj, n]))

    def propagate(self, turn: int) -> None:
        """Take over all offsets of the neighbours scanned before: above and left, or below and right on odd turns."""
        for i, j in self._diagonals(turn % 2 == 1):
            self._take_over(i, j, 1 if turn % 2 else -1, self.k)

    def search(self, radius: float) -> None:
        """Around each offset a normal one."""
        i, j = (c.ravel() for c in np.indices(self.place.shape))
        before = [c.reshape(-1, self.k).copy() for c in (self.dist, self.dy, self.dx)]
        for n in range(self.k):
            ey, ex = (c.ravel() for c in self.normal(radius))
            self.offer(i, j, before[1][:, n] + ey, before[2][:, n] + ex, np.isfinite(before[0][:, n]))

    def run(self, turns: int) -> None:
        self.start()
        for turn in range(turns):
            self.propagate(turn)
            self.search(max((self.window or min(self.h, self.w)) * 0.5**turn, 1.0))

    def run_best(self, turns: int) -> None:
        """The lean variant: neighbours pass on their best offset only, and each center then tries one uniform
        offset around its best, in a square whose radius shrinks from a quarter of the width to one."""
        self.start()
        for turn in range(turns):
            reach = max(1, int(self.w // 4 * 0.5**turn))
            e = np.floor(self.uniform(2) * (2 * reach + 1)).astype(int) - reach
            for i, j in self._diagonals():
                self._take_over(i, j, -1, 1)
                self.offer(i, j, self.dy[i, j, 0] + e[i, j, 0], self.dx[i, j, 0] + e[i, j, 1], np.isfinite(self.dist[i, j, 0]))


def aknn(
    df: DataFrame, height: int, width: int, *, k: int = 8, patch: int = 5, step: int = 2, turns: int = 2, window: int | None = None,
    tile: int = 24, overlap: int = 8, seed: int = 42, measure: str = "ssd", limit: float = 0.0, channels: int = 1, start: str = "normal",
    best_only: bool = False, apart: bool = True,
) -> DataFrame:
    """The k best patches found for each center: (img, y, x, k, dist, dy, dx), nearest first.

    Centers in the overlap of tiles are searched in each, and the best k distinct offsets stay.
    """

    def work(at: Tile) -> dict[str, np.ndarray] | None:
        if min(at.planes[0].shape[1:]) < patch:
            return None
        found = Search(at.planes[0], k=k, patch=patch, step=step, window=window, seed=seed, origin=(at.y0, at.x0), measure=measure, limit=limit, apart=apart, start=start)
        (found.run_best if best_only else found.run)(turns)
        i, j, n = np.nonzero(np.isfinite(found.dist))
        return {"y": found.rows[i] + at.y0, "x": found.cols[j] + at.x0, "dist": found.dist[i, j, n], "dy": found.dy[i, j, n], "dx": found.dx[i, j, n]}

    each = per_tile(df, ["img"], height, width, work, "y int, x int, dist double, dy int, dx int", tile=tile, overlap=overlap, channels=channels)
    lists = each.groupBy("img", "y", "x").agg(F.slice(F.array_sort(F.collect_set(F.struct("dist", "dy", "dx"))), 1, k).alias("best"))
    return lists.select("img", "y", "x", F.posexplode("best").alias("at", "b")).select(
        "img", "y", "x", (F.col("at") + 1).alias("k"), "b.dist", "b.dy", "b.dx"
    )


def recall(df: DataFrame, height: int, width: int, *, k: int, patch: int, step: int, window: int, **search) -> DataFrame:
    """How much of the exact nearest patches in the window the search finds: one row an image (img, centers, recall).

    The exact ones obey the same rules: patches inside, no near-copy of the center's place.
    """
    r = patch // 2
    every = match.patches(df, height, width, patch)
    refs = every.where(((F.col("y") % step) == 0) & ((F.col("x") % step) == 0))
    refs = refs.select("img", F.col("y").alias("ref_y"), F.col("x").alias("ref_x"), F.col("p").alias("ref_p"))
    pairs = match.window_pairs(refs, every, window // 2).withColumn("dist", match.ssd("ref_p", "p"))
    far = (F.abs(F.col("y") - F.col("ref_y")) > r) | (F.abs(F.col("x") - F.col("ref_x")) > r) | ((F.col("y") == F.col("ref_y")) & (F.col("x") == F.col("ref_x")))
    exact = match.top(pairs.where(far).drop("p", "ref_p"), k, ["img", "ref_y", "ref_x"], ["dist", "y", "x"])
    exact = exact.select("img", (F.col("ref_y") + r).alias("y"), (F.col("ref_x") + r).alias("x"), (F.col("y") - F.col("ref_y")).alias("dy"), (F.col("x") - F.col("ref_x")).alias("dx"))
    found = aknn(df, height, width, k=k, patch=patch, step=step, window=window, **search).select("img", "y", "x", "dy", "dx", F.lit(1).alias("hit"))
    both = exact.join(found, ["img", "y", "x", "dy", "dx"], "left")
    return both.groupBy("img").agg(F.countDistinct("y", "x").alias("centers"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
