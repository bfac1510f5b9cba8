"""Patch matching: each reference patch meets the patches of a window, and the nearest are kept.

A tile takes the distances of all its references at one offset from one array of differences, so a
distance doesn't cost a patch. `window_pairs` is the relational form, a halo join of patch arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators import blocks
from pixelweave.operators.tiles import Tile, per_tile


def patches(df: DataFrame, height: int, width: int, patch: int, value: str = "v") -> DataFrame:
    """Every patch that fits, by its top-left corner: (img, y, x, p), p row by row."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(patch) for j in range(patch)))
    cells = df.select("img", "y", "x", F.col(value).alias("v"), F.explode(steps).alias("o"))
    cells = cells.select("img", (F.col("y") - F.col("o.i")).alias("y"), (F.col("x") - F.col("o.j")).alias("x"), F.struct("o.i", "o.j", "v").alias("c"))
    inside = F.col("y").between(0, height - patch) & F.col("x").between(0, width - patch)
    grouped = cells.where(inside).groupBy("img", "y", "x").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return grouped.select("img", "y", "x", F.transform("c", lambda c: c["v"]).alias("p"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, d: s + d)


def ssd(a: str, b: str) -> Column:
    """Sum of squared differences of integer patches, exact."""
    return _sum(F.zip_with(a, b, lambda u, v: ((u - v) * (u - v)).cast("long")))


def window_pairs(refs: DataFrame, cands: DataFrame, radius: int) -> DataFrame:
    """Pairs of a reference and a candidate (y, x, p) at most `radius` rows and columns away.

    A halo join: buckets are `radius` + 1 wide, a candidate is copied to the 3 x 3 buckets around
    its own, and an equi-join on the bucket with a residual filter replaces the range join.
    """
    size = radius + 1
    bucket = lambda c: F.floor(F.col(c) / size).cast("int")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = cands.withColumn("o", F.explode(around))
    spread = spread.withColumns({"by": bucket("y") + F.col("o.i"), "bx": bucket("x") + F.col("o.j")}).drop("o")
    own = refs.withColumns({"by": bucket("ref_y"), "bx": bucket("ref_x")})
    keys = ["img", "by", "bx"]
    near = (F.abs(F.col("y") - F.col("ref_y")) <= radius) & (F.abs(F.col("x") - F.col("ref_x")) <= radius)
    return own.join(spread, keys).where(near).drop("by", "bx")


def top(pairs: DataFrame, k: int, keys: list[str], order: list[str]) -> DataFrame:
    """The k first rows of each group, with their rank; the filter on the rank becomes a limit per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def _nearest(
    df: DataFrame, height: int, width: int, *, patch: int, stride: int, radius: int, k: int, tile: int, value: str, measure: str = "ssd",
    channels: int = 1, frames: tuple[int, ...] = (0,), own: str = "skip", limit: float | None = None,
) -> DataFrame:
    """The k nearest patches of each reference, over the candidate frames t, in tiles: (img, ref_y, ref_x, rk, dist, t, y, x)."""

    def run(at: Tile) -> dict[str, np.ndarray] | None:
        rows, cols = at.corners(stride, patch)
        if not (len(rows) and len(cols)):
            return None
        cands = [(t, at.planes[t]) for t in frames if t in at.planes]
        ok, dist, t, y, x = blocks.nearest(at.planes[0], cands, rows, cols, at.corner_range(patch), patch=patch, radius=radius, k=k, measure=measure, own=own, limit=limit)
        ref = np.stack(np.meshgrid(rows + at.y0, cols + at.x0, indexing="ij"), -1).reshape(-1, 2)
        g, rank = np.nonzero(ok)
        return {"ref_y": ref[g, 0], "ref_x": ref[g, 1], "rk": rank + 1, "dist": dist[ok], "t": t[ok], "y": y[ok] + at.y0, "x": x[ok] + at.x0}

    kind = "double" if df.schema[value].dataType.typeName() in ("double", "float") else "long"
    return per_tile(
        df, ["img"], height, width, run, f"ref_y int, ref_x int, rk int, dist {kind}, t int, y int, x int",
        tile=tile, before=radius, after=radius + patch - 1, channels=channels, value=value,
    )


def match(
    df: DataFrame, height: int, width: int, *, patch: int, stride: int, radius: int, k: int, measure: str = "ssd", tile: int = 64, value: str = "v",
    own: str = "skip", limit: float | None = None,
) -> DataFrame:
    """The k nearest other patches of each reference patch: (img, ref_y, ref_x, rk, dist, y, x).

    Of equal distances the upper, then the left one comes first. `own` = "first" lists the reference
    itself first; `limit` leaves out distances from there on.
    """
    return _nearest(df, height, width, patch=patch, stride=stride, radius=radius, k=k, tile=tile, value=value, measure=measure, own=own, limit=limit).drop("t")


def finite(rows: DataFrame, value: str = "dist") -> DataFrame:
    """Rows whose distance is a finite number."""
    return rows.where(~F.isnan(value) & (F.abs(value) < float("inf")))


def match_joint(df: DataFrame, height: int, width: int, *, patch: int, stride: int, radius: int, k: int, channels: int = 4, tile: int = 64, value: str = "v") -> DataFrame:
    """`match` of images with channels (img, ch, y, x): distances are summed over the channels, so all share one group."""
    return _nearest(df, height, width, patch=patch, stride=stride, radius=radius, k=k, tile=tile, value=value, channels=channels).drop("t")


def around(df: DataFrame, frames: int) -> DataFrame:
    """Each frame with those before and after it: rows go to the frames that see them, which they are t away from."""
    near = F.explode(F.array(*(F.lit(d) for d in range(-frames, frames + 1))))
    return df.withColumn("t", near).withColumn("img", F.col("img") - F.col("t"))


def match_frames(df: DataFrame, height: int, width: int, *, patch: int, stride: int, radius: int, frames: int, k: int, tile: int = 64, value: str = "v") -> DataFrame:
    """The same over the `frames` frames before and after too: adds t, the frame of the match."""
    found = _nearest(around(df, frames), height, width, patch=patch, stride=stride, radius=radius, k=k, tile=tile, value=value, frames=tuple(range(-frames, frames + 1)))
    return found.withColumn("t", F.col("img") + F.col("t")).select("img", "ref_y", "ref_x", "rk", "dist", "t", "y", "x")


def match_before(df: DataFrame, before: DataFrame, keys: list[str], height: int, width: int, *, patch: int, stride: int, radius: int, k: int, tile: int = 64) -> DataFrame:
    """The k nearest patches in another frame of each image, by the keys that both tables have: (keys, ref_y, ref_x, rk, dist, y, x).

    An image without such a frame has none.
    """

    def run(at: Tile) -> dict[str, np.ndarray] | None:
        rows, cols = at.corners(stride, patch)
        if not (len(rows) and len(cols) and 1 in at.planes):
            return None
        ok, dist, _, y, x = blocks.nearest(at.planes[0], [(1, at.planes[1])], rows, cols, at.corner_range(patch), patch=patch, radius=radius, k=k)
        ref = np.stack(np.meshgrid(rows + at.y0, cols + at.x0, indexing="ij"), -1).reshape(-1, 2)
        g, rank = np.nonzero(ok)
        return {"ref_y": ref[g, 0], "ref_x": ref[g, 1], "rk": rank + 1, "dist": dist[ok], "y": y[ok] + at.y0, "x": x[ok] + at.x0}

    kind = "double" if df.schema["v"].dataType.typeName() in ("double", "float") else "long"
    both = df.select(*keys, F.lit(0).alias("t"), "y", "x", "v").unionByName(before.select(*keys, F.lit(1).alias("t"), "y", "x", "v"))
    return per_tile(both, keys, height, width, run, f"ref_y int, ref_x int, rk int, dist {kind}, y int, x int", tile=tile, before=radius, after=radius + patch - 1)


def match_all(df: DataFrame, height: int, width: int, *, patch: int, ref: tuple[int, int], k: int, value: str = "v") -> DataFrame:
    """One reference patch of each image against all its patches, itself included."""
    every = patches(df, height, width, patch, value)
    one = every.where((F.col("y") == ref[0]) & (F.col("x") == ref[1])).select("img", F.col("y").alias("ref_y"), F.col("x").alias("ref_x"), F.col("p").alias("ref_p"))
    pairs = every.join(one, "img").withColumn("dist", ssd("ref_p", "p"))
    return top(pairs, k, ["img", "ref_y", "ref_x"], ["dist", "y", "x"]).select("img", "ref_y", "ref_x", "rk", "dist", "y", "x")


def pool(spatial: DataFrame, temporal: DataFrame, keys: list[str], size: int = 8) -> DataFrame:
    """Spatio-temporal groups: the reference first, then the nearest size - 1 of both tables, filled up with the reference.

    Tables hold keys, dist, dy, dx and k, their rank. A temporal candidate wins a tie.
    Returns keys, slot (0 first), t (1 for the frame before), dy, dx.
    """
    spatial = spatial.where("dy <> 0 or dx <> 0").select(*keys, "dist", F.lit(0).alias("t"), "dy", "dx", "k")
    every = spatial.unionByName(temporal.select(*keys, "dist", F.lit(1).alias("t"), "dy", "dx", "k"))
    w = Window.partitionBy(*keys).orderBy("dist", F.desc("t"), "k")
    best = every.withColumn("slot", F.row_number().over(w)).where(F.col("slot") < size).select(*keys, "slot", "t", "dy", "dx")
    slots = every.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    zero = F.lit(0)
    return slots.join(best, [*keys, "slot"], "left").select(*keys, "slot", *(F.coalesce(c, zero).alias(c) for c in ("t", "dy", "dx")))


def group_arrays(df: DataFrame, matches: DataFrame, height: int, width: int, patch: int) -> DataFrame:
    """Groups as arrays: (img, ref_y, ref_x, members, patches), the reference first, then its matches by rank.

    `members` lists (t, y, x), `patches` each member's values row by row. A group is as large as its
    list of matches, so its array is bounded; the join is on patch and frame.
    """
    keys = ["img", "ref_y", "ref_x"]
    t = F.col("t") if "t" in matches.columns else F.col("img")
    own = matches.where("rk = 1").select(*keys, F.lit(0).alias("rk"), F.col("img").alias("t"), F.col("ref_y").alias("y"), F.col("ref_x").alias("x"))
    members = own.unionByName(matches.select(*keys, "rk", t.alias("t"), "y", "x"))
    rows = members.join(patches(df, height, width, patch).withColumnRenamed("img", "t"), ["t", "y", "x"])
    group = F.sort_array(F.collect_list(F.struct("rk", "t", "y", "x", "p")))
    return rows.groupBy(*keys).agg(group.alias("g")).select(*keys, F.transform("g", lambda m: F.struct(m["t"], m["y"], m["x"])).alias("members"), F.col("g.p").alias("patches"))
