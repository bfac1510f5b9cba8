"""Searches and group filters on the arrays of one tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pixelweave.functions import kernels

CHUNK = 512  # groups that are transformed at once


def box_sums(a: np.ndarray, rows: np.ndarray, cols: np.ndarray, patch: int) -> np.ndarray:
    """Sums over the patch x patch boxes with these corners. Of integers by a summed-area table; of reals, whose differences would not be exact, axis by axis."""
    if a.dtype.kind == "i":
        table = np.zeros((a.shape[0] + 1, a.shape[1] + 1), a.dtype)
        np.cumsum(np.cumsum(a, 0), 1, out=table[1:, 1:])
        low, high = table[rows], table[rows + patch]
        return high[:, cols + patch] - high[:, cols] - low[:, cols + patch] + low[:, cols]
    tall = sum(a[rows + i] for i in range(patch))
    return sum(tall[:, cols + j] for j in range(patch))


def _smallest(dist: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the places of the k smallest values in order; of equal ones the first."""
    n = dist.shape[1]
    if dist.dtype.kind == "i" and dist.size and int(dist.max()) < (1 << 62) // n:
        keyed = dist * n + np.arange(n)
        if k < n:
            keyed = np.partition(keyed, k - 1, axis=1)[:, :k]
        return np.sort(keyed, axis=1) % n
    return np.argsort(dist, axis=1, kind="stable")[:, :k]


def nearest(
    ref: np.ndarray, cands: list[tuple[int, np.ndarray]], rows: np.ndarray, cols: np.ndarray, valid: tuple[int, int, int, int], *,
    patch: int, radius: int, k: int, measure: str = "ssd", own: str = "skip", limit: float | None = None,
) -> tuple[np.ndarray, ...]:
    """The k nearest patches within `radius` rows and columns of each corner (rows x cols), over candidate frames (t, planes).

    Differences are taken for a whole tile at each offset and summed by boxes, so a distance doesn't
    cost a patch. Ties go to the smaller t, then row, then column. `own` skips the patch itself or
    puts it first; `limit` excludes distances from there on. Returns ok, dist, t, y, x by (corner, rank).
    """
    span = range(-radius, radius + 1)
    whole = ref.dtype.kind == "i"
    none = (1 << 40) * 1 << 8 if whole else np.inf
    steps = np.array([(t, dy, dx) for t, _ in cands for dy in span for dx in span])
    dist = np.empty((len(steps), len(rows), len(cols)), ref.dtype)
    ya, yb, xa, xb = rows[0], rows[-1] + patch, cols[0], cols[-1] + patch
    base = ref[:, ya:yb, xa:xb]
    fits = {d: (rows + d >= valid[0]) & (rows + d <= valid[1]) for d in span}, {d: (cols + d >= valid[2]) & (cols + d <= valid[3]) for d in span}
    at = 0
    for t, plane in cands:
        for dy in span:
            for dx in span:
                diff = base - plane[:, ya + dy : yb + dy, xa + dx : xb + dx]
                cost = (np.abs(diff) if measure == "sad" else diff * diff).sum(0)
                got = box_sums(cost, rows - ya, cols - xa, patch)
                ok = np.outer(fits[0][dy], fits[1][dx])
                if limit is not None:
                    ok &= got < limit
                if t == 0 and dy == 0 and dx == 0:
                    got, ok = got - (1 if own == "first" else 0), ok if own == "first" else np.zeros_like(ok)
                dist[at] = np.where(ok, got, none)
                at += 1
    flat = dist.reshape(len(steps), -1).T
    order = _smallest(np.ascontiguousarray(flat), min(k, len(steps)))
    best = np.take_along_axis(flat, order, 1)
    chosen = steps[order]
    corner = np.stack(np.meshgrid(rows, cols, indexing="ij"), -1).reshape(-1, 1, 2)
    return best < none, np.maximum(best, 0), chosen[..., 0], corner[..., 0] + chosen[..., 1], corner[..., 1] + chosen[..., 2]


def group_filter(
    stack: np.ndarray, t: np.ndarray, y: np.ndarray, x: np.ndarray, size: np.ndarray, *, patch: int, kind: str, limit: np.ndarray | float,
    variance: np.ndarray | None = None, window: np.ndarray | None = None, only: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Collaborative filtering of groups: their patches as matrices, transformed along three axes, thresholded, and added up where they came from.

    stack: (frame, channel, row, column); t, y, x: (group, member) places in it, of which the first
    `size` count. Groups of one member are skipped. `limit` and `variance` may differ by group; the
    weight 1 / (nonzero coefficients * variance) is the mean over the channels. With `only`, members
    of other frames are not written. Returns the weighted sums and the weights, shaped as the stack.
    """
    num, den = np.zeros(stack.shape), np.zeros(stack.shape)
    views = np.lib.stride_tricks.sliding_window_view(stack, (patch, patch), axis=(2, 3))
    flat = np.array(kernels.dct(patch))
    win = np.ones((patch, patch)) if window is None else window
    cells = (np.arange(patch)[:, None] * stack.shape[3] + np.arange(patch)).ravel()
    for g, n in _by_size(size):
        along, back = (np.array(m) for m in (kernels.haar(n) if kind == "haar" else (kernels.dct(n), np.transpose(kernels.dct(n)))))
        gt, gy, gx = t[g, :n], y[g, :n], x[g, :n]
        coefs = flat @ views[gt, :, gy, gx] @ flat.T  # (group, member, channel, i, j)
        coefs = np.tensordot(along, coefs, (1, 1)).swapaxes(0, 1)
        least = np.asarray(limit)[g, None, None, None, None] if np.ndim(limit) else limit
        coefs[np.round(np.abs(coefs), 9) < least] = 0.0  # at nine decimals, so that no last bit decides
        left = np.maximum(np.count_nonzero(coefs, axis=(1, 3, 4)), 1)
        weight = (1.0 / (left * (variance[g, None] if variance is not None else 1.0))).mean(1)
        patches = flat.T @ np.tensordot(back, coefs, (1, 1)).swapaxes(0, 1) @ flat
        share = weight[:, None, None, None, None] * win
        if only is not None:
            share = share * (gt == only)[:, :, None, None, None]
        corner = ((gt[..., None] * stack.shape[1] + np.arange(stack.shape[1])) * stack.shape[2] + gy[..., None]) * stack.shape[3] + gx[..., None]
        at = (corner[..., None] + cells).ravel()
        num += np.bincount(at, (patches * share).ravel(), num.size).reshape(num.shape)
        den += np.bincount(at, np.broadcast_to(share, patches.shape).ravel(), den.size).reshape(den.shape)
    return num, den


def _by_size(size: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    for n in np.unique(size[size > 1]):
        every = np.flatnonzero(size == n)
        for s in range(0, len(every), CHUNK):
            yield every[s : s + CHUNK], int(n)


def shifted(a: np.ndarray, dy: int, dx: int, margin: int) -> np.ndarray:
    """The array moved by an offset, without `margin` cells on each side."""
    h, w = a.shape[-2:]
    return a[..., margin + dy : h - margin + dy, margin + dx : w - margin + dx]


def correlate(a: np.ndarray, kernel: list[tuple], margin: int) -> np.ndarray:
    """Weighted sums over the neighbours (dy, dx, w), without `margin` cells on each side."""
    return sum(shifted(a, dy, dx, margin) * w for dy, dx, w in kernel)


def blurred(a: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A separable kernel on the last two axes, without the cells that it can't reach."""
    n, (h, w) = len(line), a.shape[-2:]
    tall = sum(a[..., i : h - n + 1 + i, :] * v for i, v in enumerate(line))
    return sum(tall[..., j : w - n + 1 + j] * v for j, v in enumerate(line))


def gaussian_line(radius: int, sigma: float) -> np.ndarray:
    d = np.arange(-radius, radius + 1)
    line = np.exp(-(d * d) / (2 * sigma * sigma)) if sigma else np.ones(len(d))
    return line / line.sum()
