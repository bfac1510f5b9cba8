"""Experiment catalogues: parsed paths, joins with parameters, unified result rows, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import ranks

KEYS = ["scene", "iso", "frame"]


def number(path: Column, pattern: str) -> Column:
    """The number in the first group of a pattern; -1 without a match."""
    return F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("int"), F.lit(-1))


def parsed(paths: DataFrame) -> DataFrame:
    """Scene, sensitivity, frame and realization of each distinct file; realization null for clean files."""
    p = F.col("path")
    clean = p.rlike(r"_clean\.tiff$")
    return paths.select("path").distinct().select(
        "path", F.regexp_extract(p, r"/(scene\d+)/", 1).alias("scene"),
        F.regexp_replace(F.regexp_extract(p, r"/(ISO\d+)/", 1), r"\D", "").try_cast("int").alias("iso"),
        number(p, r"frame(\d+)_(?:clean|noisy)").alias("frame"), clean.alias("is_clean"),
        F.when(~clean, number(p, r"_noisy(\d+)\.tiff$")).alias("noisy_idx"),
    )


def tasks(files: DataFrame) -> DataFrame:
    """Noisy files with the clean file of their frame; frames without one are left out."""
    clean = files.where("is_clean").select(*KEYS, F.col("path").alias("clean_path"))
    return files.where("not is_clean").join(clean, KEYS).select(*KEYS, "noisy_idx", F.col("path").alias("noisy_path"), "clean_path")


def first_per_key(params: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None) -> DataFrame:
    """The first row of each key, in an explicit order. An aggregate on the map side, no window over a hot key."""
    order = order or ["noisy_idx", "event_id"]
    rest = [c for c in params.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return params.groupBy(*keys).agg(first.alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(params, KEYS)


def without_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows whose key has no parameters, to report."""
    return rows.join(params, KEYS, "left_anti")


def filtered(rows: DataFrame, **equal: object) -> DataFrame:
    """Optional equality filters; None means any."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), rows)


def by_position(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Pair the sorted rows of two tables within a group by their position; the left ones stay.

    Positions are global ranks, so a group may be as large as the table.
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        placed = ranks.before(df.select(group, order), [group], [order], "pos")
        return placed.select(group, (F.col("pos") + 1).cast("int").alias("pos"), F.col(order).alias(name))

    return ranked(left, "left_item").join(ranked(right, "right_item"), [group, "pos"], "left")


def channel_noise(scenes: DataFrame) -> DataFrame:
    """Gain and standard deviation of the four mosaic channels, from a scene's camera, pattern and color coefficients."""
    color = F.lower(F.col("color"))
    pick = lambda stem: F.when(color == "r", F.col(f"{stem}_r")).when(color == "g", F.col(f"{stem}_g")).otherwise(F.col(f"{stem}_b"))
    cells = scenes.withColumn("camera", F.split("scene_instance_id", "_")[2]).select(
        "*", F.posexplode(F.split("bayer_pattern", "")).alias("ch", "color"), F.instr(F.upper("bayer_pattern"), "G").alias("first_green")
    )
    cells = cells.where(F.col("color") != "")
    return cells.select(
        "scene_instance_id", "camera", "ch", "color", pick("beta1").alias("gain"),
        F.sqrt(F.greatest(pick("beta2"), F.lit(0.0))).alias("sigma"), (F.col("first_green") - 1).alias("first_green"),
    )


def unified(tables: list[DataFrame]) -> DataFrame:
    """Result rows of methods with different columns in one form.

    Time is matching plus filtering, or else the one time there is, or 0; the gain is the first
    that is neither null nor 0; the variance comes from whichever column holds it.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    want = ["time_match_s", "time_filter_s", "time_s", "a_norm", "a_gat", "beta1", "sigma_norm", "beta2", "sigma_gat"]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in want if c not in rows.columns})
    zero = F.lit(0.0)
    return rows.select(
        "method", "frame", "psnr",
        F.coalesce(F.col("time_match_s") + F.col("time_filter_s"), "time_s", "time_filter_s", zero).alias("time_all"),
        F.coalesce(*(F.nullif(F.col(c), zero) for c in ("a_norm", "a_gat", "beta1")), zero).alias("a_norm"),
        F.coalesce("sigma_norm", "beta2", F.col("sigma_gat") * F.col("sigma_gat"), zero).alias("sigma_norm"),
    )


def with_extension(paths: DataFrame, *extensions: str) -> DataFrame:
    """Files of some extensions, in upper or lower case."""
    return paths.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]))


def result_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Result rows with a fixed header in a total order (a range shuffle, no single task)."""
    missing = {c: F.lit(None).cast("double") for c in columns if c not in rows.columns}
    return rows.withColumns(missing).select(*columns).orderBy(*order)


def parameter_grid(df: DataFrame, **values: list) -> DataFrame:
    """Each row with all combinations of short lists."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(o) for o in options))))
    return df
