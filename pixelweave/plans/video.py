"""Recursive video filtering: each frame is filtered with the help of the filtered frame before it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions import scalars
from pixelweave.operators import match
from pixelweave.plans import denoise
from pixelweave.sources import staging


def numbered(frames: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """One row for each frame that exists: keys, frame, its step in its sequence from 1, and before, the last frame that exists.

    Frames may be missing; a sequence goes on after a gap with the frame it had before it. The window
    is over frames, not pixels.
    """
    order = Window.partitionBy(*keys).orderBy(frame)
    return frames.select(*keys, frame).distinct().withColumns({"step": F.row_number().over(order), "before": F.lag(frame).over(order)})


def temporal_matches(frames: DataFrame, keys: list[str], height: int, width: int, *, patch: int, stride: int, radius: int = 4, k: int = 3, frame: str = "frame") -> DataFrame:
    """The k nearest patches of each reference in the last frame before its own: (keys, frame, before, ref_y, ref_x, rk, dist, y, x).

    A frame is also dealt to the frame that follows it, so a tile holds both, and the search is a halo
    join by sequence and position. First frames have no matches.
    """
    steps = numbered(frames, keys, frame)
    ahead = frames.join(steps.select(*keys, F.col("before").alias(frame), F.col(frame).alias("_next")).where(F.col(frame).isNotNull()), [*keys, frame])
    earlier = ahead.select(*keys, F.col("_next").alias(frame), "y", "x", "v")
    found = match.match_before(frames, earlier, [*keys, frame], height, width, patch=patch, stride=stride, radius=radius, k=k)
    return found.join(steps.select(*keys, frame, "before"), [*keys, frame]).select(*keys, frame, "before", "ref_y", "ref_x", "rk", "dist", "y", "x")


def recursive(
    raw: DataFrame, keys: list[str], height: int, width: int, a: float, b: float, *, frame: str = "frame", channels: int = 1, state: str | None = None, **search: int | str,
) -> DataFrame:
    """Filter sequences (keys, frame, [ch,] y, x, v) frame by frame: (keys, frame, [ch,] y, x, v).

    The state of a sequence is its last filtered frame, stabilized; a first frame is filtered
    spatially. All sequences advance together: one job a step, in which every tile of every
    sequence's next frame is a task's work, so there are as many jobs as the longest sequence has
    frames. A step's result is written to the shared folder, and the next step reads only it and the
    frames of its own step. With a `state` folder that outlives the session, steps that it holds are
    not done again, and more frames may be added at the end. Missing frames don't reset a state.
    """
    spark = raw.sparkSession
    if state is None:
        state = f"{staging.shared_dir(spark)}/video-{uuid.uuid4().hex}"
        staging.until_exit(spark, state)
    names = [*keys, frame, *(["ch"] if channels > 1 else []), "y", "x"]
    noisy = raw.join(numbered(raw, keys, frame).drop("before"), [*keys, frame])
    noisy = noisy.select(*names, scalars.vst(scalars.normalized(F.col("v")), a, b).alias("v"), "step")
    noisy = staging.staged(noisy, f"{state}/noisy", "step")
    last = noisy.agg(F.max("step")).first()[0] or 0  # from the names of the folders
    done = []
    for step in range(1, last + 1):
        path = f"{state}/filtered-{step}"
        if not staging.finished(spark, path):
            now = noisy.where(F.col("step") == step).drop("step").withColumn("t", F.lit(0))
            both = now.drop(frame)
            if done:
                both = both.unionByName(done[-1].drop(frame).withColumn("t", F.lit(1)))
            out = denoise.search_filter(both, keys, height, width, channels=channels, **search)
            out = out.join(now.select(*keys, frame).distinct(), keys).select(*names, "v")
            out.write.mode("overwrite").parquet(path)
        done.append(spark.read.parquet(path).select(*names, "v"))
    if not done:
        return noisy.drop("step")
    whole = spark.read.parquet(*(f"{state}/filtered-{step}" for step in range(1, last + 1))).select(*names, "v")
    return whole.withColumn("v", scalars.clip(scalars.gat_inverse(F.col("v"), a, b**0.5), 0.0, 1.0))
