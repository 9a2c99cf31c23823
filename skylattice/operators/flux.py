"""Flux-divergence emission maps.

The divergence is linear, so the weighted mean flux is aggregated first and differentiated once per map. Main
estimate, resamples and seasons are rows of one weights table and become one shuffle on (keys, pixel).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.materialise import task_slots
from skylattice.operators.raster import densify, gradient, pixel_area_m2, spacing_m
from skylattice.operators.sizing import join_on
from skylattice.settings import MOLAR_MASS_NO2, GridSpec


def mean_flux(cube: DataFrame, wind: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = (),
              value: str = "value") -> DataFrame:
    """(keys, iy, ix, fx, fy, vbar): weighted means of V*u, V*v and V over the valid overpasses.

    The rows of a pixel meet before replicates multiply them, and stay together: a replicate's sums need no further shuffle.
    The weights go to every task as one list for each overpass.
    """
    keys = list(keys)
    # several observations of a pixel in one overpass collapse before replicates multiply the rows
    part = (cube.where(F.col(value).isNotNull()).groupBy("overpass", "iy", "ix")
            .agg(F.sum(value).alias("sv"), F.count("*").alias("n")).join(wind.select("overpass", "u", "v"), "overpass"))
    if weights is None:
        part = part.withColumn("w", F.lit(1.0))
    else:
        lists = weights.groupBy("overpass").agg(F.collect_list(F.struct(*keys, "w")).alias("__w"))
        part = part.repartition(task_slots(cube.sparkSession), "iy", "ix").join(F.broadcast(lists), "overpass")
        part = part.select("overpass", "iy", "ix", "sv", "n", "u", "v", F.explode("__w").alias("__w")).select("*", "__w.*").drop("__w")
    den = F.sum(F.col("w") * F.col("n"))
    num = lambda c: F.sum(F.col("w") * F.col("sv") * c)
    return part.groupBy(*keys, "iy", "ix").agg(F.try_divide(num(F.col("u")), den).alias("fx"),
                                               F.try_divide(num(F.col("v")), den).alias("fy"),
                                               F.try_divide(num(F.lit(1.0)), den).alias("vbar"))


def emission_map(flux: DataFrame, spec: GridSpec, tau_s: Column | float, v_bg: Column | float, ratio: float,
                 keys: Sequence[str] = ()) -> DataFrame:
    """(keys, iy, ix, vbar, div, sink, emission) with emission = ratio * (div + (vbar - v_bg) / tau).

    `tau_s` and `v_bg` may be columns of `flux`, so lifetime and background variants go through as keys.
    """
    keys = list(keys)
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    flux = flux.withColumn("__sink", (F.col("vbar") - lit(v_bg)) / lit(tau_s))
    dx, dy = spacing_m(spec)
    d = densify(flux, spec, keys, ["fx", "fy", "vbar", "__sink"])
    d = d.withColumn("__gx", gradient(d, "fx", "ix", spec.n_cols, dx, keys))
    d = d.withColumn("__gy", gradient(d, "fy", "iy", spec.n_rows, -dy, keys))
    return (d.withColumn("div", F.col("__gx") + F.col("__gy")).withColumn("sink", F.col("__sink"))
            .withColumn("emission", ratio * (F.col("div") + F.col("sink")))
            .select(*keys, "iy", "ix", "vbar", "div", "sink", "emission"))


def lifetime_background_variants(flux: DataFrame, variants: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Repeat each flux row per (variant, tau_s, v_bg); both are expressions over the row."""
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), t.cast("double").alias("tau_s"), b.cast("double").alias("v_bg"))
                     for n, t, b in variants])
    return flux.withColumn("__v", F.explode(rows)).select("*", "__v.*").drop("__v")


def mass_rate(spec: GridSpec, molar_mass: float = MOLAR_MASS_NO2, value: str = "emission") -> Column:
    """kg/s emitted by one pixel; NULL pixels add nothing to a sum."""
    return F.col(value) * F.lit(pixel_area_m2(spec) * molar_mass)


def static_pattern_removed(cube: DataFrame, elevation: DataFrame | None, scale_height_km: float, value: str = "value") -> DataFrame:
    """Anomaly of a well-mixed tracer: terrain normalisation, then minus the overpass median, then minus the pixel mean."""
    from skylattice.functions.values import terrain_normalised
    from skylattice.operators.quantiles import exact_quantiles

    x = cube
    if elevation is not None:
        x = x.join(elevation.select("iy", "ix", "elevation_m"), ["iy", "ix"], "left")
        x = x.withColumn(value, terrain_normalised(value, "elevation_m", scale_height_km)).drop("elevation_m")
    mid = exact_quantiles(x, ["overpass"], value, {"__mid": 0.5})
    x = join_on(x, mid, ["overpass"], "left").withColumn(value, F.col(value) - F.col("__mid")).drop("__mid")
    return group_anomaly(x, ["iy", "ix"], value)


def group_anomaly(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Value minus its group mean. The mean is a mergeable aggregate joined back, so no window holds a hot group."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
    return join_on(df, means, list(keys), "left").withColumn(out or value, F.col(value) - F.col("__m")).drop("__m")
