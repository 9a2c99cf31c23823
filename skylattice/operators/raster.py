"""Raster operators on long tables (grid keys, iy, ix, value): iy runs north to south, ix west to east.

Box and maximum filters are separable: one pass along rows, one along columns, each a bounded frame inside one
raster line. Several maps (replicates, variants, overpasses) go through together as leading grid keys.
Shuffles: (keys, iy) then (keys, ix) per filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.sizing import join_on
from skylattice.settings import KM_PER_DEG_LAT, KM_PER_DEG_LON_EQUATOR, GridSpec


def pixel_grid(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All pixel centres of a grid, rows north to south."""
    ids = spark.range(spec.n_rows * spec.n_cols)
    iy = F.expr(f"cast(id div {spec.n_cols} as int)")
    ix = (F.col("id") % spec.n_cols).cast("int")
    return ids.select(iy.alias("iy"), ix.alias("ix"), (F.lit(spec.lat_top) - iy * spec.res).alias("lat"),
                      (F.lit(spec.lon_left) + ix * spec.res).alias("lon"))


def densify(df: DataFrame, spec: GridSpec, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every pixel of every map present in `df`; pixels without a row get NULL values."""
    keys = list(keys)
    spark = df.sparkSession
    if not keys:
        return pixel_grid(spark, spec).select("iy", "ix").join(df.select("iy", "ix", *values), ["iy", "ix"], "left")
    maps = df.select(*keys).distinct()
    full = (maps.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(spec.n_rows - 1))))
            .withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(spec.n_cols - 1)))))
    return join_on(full, df.select(*keys, "iy", "ix", *values), [*keys, "iy", "ix"], "left")


def _mirrored(pos: str, n: int, half: int) -> str:
    """All positions in [-half, n-1+half] at which the pixel `pos` shows when the edge is mirrored (d c b a | a b c d)."""
    turns = -(-half // (2 * n)) + 1
    spots = ", ".join(f"{pos} + {2 * n * k}, -1 - {pos} + {2 * n * k}" for k in range(-turns, turns + 1))
    return f"explode(filter(array({spots}), p -> p >= {-half} AND p <= {n - 1 + half}))"


def _line_filter(df, keys, across, along, n, half, agg, value):
    """Apply `agg` over a centred frame of 2*half+1 pixels along one axis with mirrored edges."""
    part = ", ".join(f"`{c}`" for c in [*keys, across])
    keep = [f"`{c}`" for c in df.columns if c != value]
    frame = f"OVER (PARTITION BY {part} ORDER BY __p ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return (df.selectExpr("*", f"{_mirrored(along, n, half)} AS __p")
            .selectExpr(*keep, "__p", f"{agg}(`{value}`) {frame} AS `{value}`").where(f"__p = {along}").drop("__p"))


def box_mean(df: DataFrame, spec: GridSpec, size: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over size x size pixels; input must be dense and filled."""
    out = df.select(*keys, "iy", "ix", value)
    out = _line_filter(out, keys, "iy", "ix", spec.n_cols, size // 2, "avg", value)
    return _line_filter(out, keys, "ix", "iy", spec.n_rows, size // 2, "avg", value)


def box_max(df: DataFrame, spec: GridSpec, size: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    out = df.select(*keys, "iy", "ix", value)
    out = _line_filter(out, keys, "iy", "ix", spec.n_cols, size // 2, "max", value)
    return _line_filter(out, keys, "ix", "iy", spec.n_rows, size // 2, "max", value)


def box_median(df: DataFrame, spec: GridSpec, size: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median over size x size pixels (odd size): a bounded list per pixel, gathered axis by axis."""
    half = size // 2
    out = df.select(*keys, "iy", "ix", value)
    out = _line_filter(out, keys, "iy", "ix", spec.n_cols, half, "collect_list", value)
    out = _line_filter(out, keys, "ix", "iy", spec.n_rows, half, "collect_list", value)
    return out.withColumn(value, F.element_at(F.sort_array(F.flatten(value)), size * size // 2 + 1))


def fill_missing(df: DataFrame, value: str, how: str = "zero", keys: Sequence[str] = ()) -> DataFrame:
    """Replace NULL by 0 or by the mean of the map."""
    if how == "zero":
        return df.withColumn(value, F.coalesce(value, F.lit(0.0)))
    if how != "mean":
        raise ValueError(how)
    if keys:
        means = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
        return join_on(df, means, list(keys)).withColumn(value, F.coalesce(value, "__m")).drop("__m")
    tagged, means = df.withColumn("__k", F.lit(0)), df.agg(F.avg(value).alias("__m")).withColumn("__k", F.lit(0))
    return tagged.join(F.broadcast(means), "__k").withColumn(value, F.coalesce(value, "__m")).drop("__k", "__m")


def spacing_m(spec: GridSpec) -> tuple[float, float]:
    """Pixel spacing east and north in metres, constant at the mean latitude."""
    import math

    dx = spec.res * KM_PER_DEG_LON_EQUATOR * math.cos(math.radians(spec.lat_mid)) * 1000
    return dx, spec.res * KM_PER_DEG_LAT * 1000


def pixel_area_m2(spec: GridSpec) -> float:
    dx, dy = spacing_m(spec)
    return dx * dy


def gradient(df: DataFrame, value: str, axis: str, n: int, step_m: float, keys: Sequence[str] = ()) -> Column:
    """Central difference along an axis, one-sided at the two ends; a missing neighbour or centre gives NULL.

    `step_m` is signed: y decreases with iy.
    """
    if n < 2:
        return F.lit(None).cast("double")
    part = ", ".join(f"`{c}`" for c in [*keys, "iy" if axis == "ix" else "ix"])
    w = f"OVER (PARTITION BY {part} ORDER BY {axis})"
    prev, nxt = f"lag(`{value}`) {w}", f"lead(`{value}`) {w}"
    return F.expr(f"""CASE WHEN `{value}` IS NULL THEN NULL WHEN {axis} = 0 THEN ({nxt} - `{value}`) / {step_m!r}D
      WHEN {axis} = {n - 1} THEN (`{value}` - {prev}) / {step_m!r}D ELSE ({nxt} - {prev}) / {2 * step_m!r}D END""")


def local_peaks(df: DataFrame, spec: GridSpec, size: int, quantile: float, value: str) -> DataFrame:
    """Pixels equal to the maximum of their size x size surroundings and above a quantile of the map."""
    from skylattice.operators.quantiles import exact_quantiles

    top = box_max(df, spec, size, value).withColumnRenamed(value, "__top")
    cut = exact_quantiles(df, [], value, {"__cut": quantile}).withColumn("__k", F.lit(0))
    return (df.join(top, ["iy", "ix"]).withColumn("__k", F.lit(0)).join(F.broadcast(cut), "__k")
            .where((F.col(value) == F.col("__top")) & (F.col(value) > F.col("__cut")))
            .drop("__k", "__top", "__cut"))
