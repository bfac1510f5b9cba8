"""Rasters as arrays inside tasks: pixels are dealt to tiles with a halo, and numpy works on a tile.

One shuffle brings a tile its pixels and those around it that its work can see. A tile's size bounds
the memory of a task, whatever the raster's size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixelweave.operators.layout import starts

TILE = 128


@dataclass
class Tile:
    """The pixels of a tile and its halo: `planes[t][ch]` is the array of a frame and channel, zero outside of the raster.

    y0 and x0 are the raster's coordinates of an array's first cell; `own` is the tile without halo,
    (top, bottom, left, right) in the array, half open.
    """

    key: tuple
    y0: int
    x0: int
    height: int
    width: int
    own: tuple[int, int, int, int]
    planes: dict[int, np.ndarray] = field(default_factory=dict)

    def mirrored(self, a: np.ndarray, border: str) -> np.ndarray:
        """The last two axes continued beyond the raster: `reflect` repeats the edge, `reflect101` doesn't."""
        skip = {"reflect": 0, "reflect101": 1}[border]
        for axis, first, size in ((-2, self.y0, self.height), (-1, self.x0, self.width)):
            at = np.arange(first, first + a.shape[axis])
            if at[0] < 0 or at[-1] >= size:
                at = np.where(at < 0, -at - 1 + skip, at)
                at = np.where(at >= size, 2 * size - 1 - skip - at, at)
                a = np.take(a, np.clip(at - first, 0, a.shape[axis] - 1), axis=axis)
        return a

    def inside(self, a: np.ndarray) -> np.ndarray:
        top, bottom, left, right = self.own
        return a[..., top:bottom, left:right]

    def own_cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Raster coordinates of the tile's cells, flat."""
        top, bottom, left, right = self.own
        y, x = np.mgrid[self.y0 + top : self.y0 + bottom, self.x0 + left : self.x0 + right]
        return y.ravel(), x.ravel()

    def corners(self, stride: int, patch: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns, in the array, of the tile's reference corners: multiples of the stride whose patches fit."""

        def on(first: int, low: int, high: int, size: int) -> np.ndarray:
            at = np.arange(-(-(first + low) // stride) * stride, min(first + high, size - patch + 1), stride)
            return at - first

        top, bottom, left, right = self.own
        return on(self.y0, top, bottom, self.height), on(self.x0, left, right, self.width)

    def corner_range(self, patch: int) -> tuple[int, int, int, int]:
        """First and last row and column, in the array, that a patch's corner may have in the raster."""
        return -self.y0, self.height - patch - self.y0, -self.x0, self.width - patch - self.x0


def _holding(axis: str, size: int, block: int, overlap: int, before: int, after: int) -> Column:
    at = F.col(axis)
    if not overlap:
        last = (size - 1) // block
        low, high = F.greatest(F.floor((at - after) / block), F.lit(0)), F.least(F.floor((at + before) / block), F.lit(last))
        return F.explode(F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda s: s * block))
    every = F.array(*(F.lit(s) for s in starts(size, block, overlap)))
    return F.explode(F.filter(every, lambda s: (s - before <= at) & (at < s + block + after)))


def per_tile(
    df: DataFrame, keys: list[str], height: int, width: int, work: Callable[[Tile], dict[str, np.ndarray]], columns: str, *,
    tile: int = TILE, overlap: int = 0, before: int = 0, after: int = 0, channels: int = 1, value: str | tuple[str, ...] = "v",
) -> DataFrame:
    """Apply a function to every tile of rasters (keys, y, x, v), with its halo.

    A column `t` may number frames that a tile sees together, and `ch` channels. A tile without
    pixels at t = 0 is skipped. Of several value columns each has its own channels, one after the other. Tiles overlap only if `overlap` says so; the last is then moved back
    to the edge. `work` returns columns of equal length, which come out with the keys in front.
    """
    values = (value,) if isinstance(value, str) else value
    t, ch = (F.col(c) if c in df.columns else F.lit(0).alias(c) for c in ("t", "ch"))
    cells = df.select(*keys, t.cast("int").alias("t"), ch.cast("int").alias("ch"), "y", "x", *(F.col(c).alias(f"v{k}") for k, c in enumerate(values)), _holding("y", height, tile, overlap, before, after).alias("ty"))
    cells = cells.select("*", _holding("x", width, tile, overlap, before, after).alias("tx"))
    whole = not any(df.schema[c].dataType.typeName() in ("double", "float") for c in values)
    head = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("t", "ch", "y", "x", *(f"v{k}" for k in range(len(values))))}
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        h, w = min(tile, height - ty), min(tile, width - tx)
        at = Tile(tuple(table.column(k)[0] for k in keys), ty - before, tx - before, height, width, (before, before + h, before, before + w))
        for t in np.unique(col["t"]):
            here = col["t"] == t
            plane = np.zeros((channels * len(values), h + before + after, w + before + after), np.int64 if whole else np.float64)
            for k in range(len(values)):
                plane[col["ch"][here] + k * channels, col["y"][here] - at.y0, col["x"][here] - at.x0] = col[f"v{k}"][here]
            at.planes[int(t)] = plane
        made = work(at) if 0 in at.planes else None
        if made is None:
            return out_schema.empty_table()
        n = len(next(iter(made.values())))
        owned = [pa.array([k.as_py()], k.type).take(pa.array(np.zeros(n, np.int64))) for k in at.key]
        return pa.Table.from_arrays([*owned, *(pa.array(made[c], out_schema.field(c).type) for c in names)], schema=out_schema)

    result = StructType.fromDDL(f"{head}, {columns}")
    names = StructType.fromDDL(columns).names
    out_schema = to_arrow_schema(result)
    return cells.groupBy(*keys, "ty", "tx").applyInArrow(run, result)


def raster(at: Tile, v: np.ndarray) -> dict[str, np.ndarray]:
    """A tile's own cells as rows (y, x, v)."""
    y, x = at.own_cells()
    return {"y": y, "x": x, "v": at.inside(v).ravel()}
