"""Wind-aligned composites: rotate each overpass about a source, bin, and integrate across the wind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geodesy import (across_wind, along_wind, bin_index, offset_east_km, offset_north_km,
                                          wind_speed, within_radius)
from skylattice.operators.raster import box_mean, densify, fill_missing
from skylattice.operators.sizing import join_on
from skylattice.settings import GridSpec, WindFrame


def wind_regimes(wind: DataFrame, regimes: dict[str, Column]) -> DataFrame:
    """(regime, overpass, u, v, ws): one row per regime an overpass belongs to; regimes may overlap."""
    named = F.array(*[F.when(c, F.lit(n)) for n, c in regimes.items()])
    return (wind.withColumn("ws", wind_speed("u", "v"))
            .withColumn("regime", F.explode(F.filter(named, lambda r: r.isNotNull()))))


def rotate_bin(obs: DataFrame, wind: DataFrame, source: tuple[float, float], frame: WindFrame = WindFrame(),
               value: str = "value") -> DataFrame:
    """(overpass, ia, ic, s, n): sum and count of valid values per overpass and wind-frame bin.

    This table feeds every composite, regime and resample. Shuffle: (overpass, ia, ic), combined on the map side.
    """
    dx, dy = offset_east_km("lon", F.lit(source[0]), F.lit(source[1])), offset_north_km("lat", F.lit(source[0]))
    r = (obs.where(F.col(value).isNotNull()).join(wind.select("overpass", "u", "v"), "overpass")
         .withColumn("ia", bin_index(along_wind(dx, dy, "u", "v"), frame.along_lo, frame.step, frame.n_along))
         .withColumn("ic", bin_index(across_wind(dx, dy, "u", "v"), -frame.across_half, frame.step, frame.n_across))
         .where(F.col("ia").isNotNull() & F.col("ic").isNotNull()))
    return r.groupBy("overpass", "ia", "ic").agg(F.sum(value).alias("s"), F.count("*").alias("n"))


def line_density(rot: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = (), frame: WindFrame = WindFrame()) -> DataFrame:
    """(keys, ia, along, line_density): mean over the non-empty across-wind bins times the total width in metres.

    `weights(keys, overpass, w)` carries replicates, regimes or seasons.
    """
    keys = list(keys)
    if weights is None:
        rot = rot.withColumn("w", F.lit(1.0))
    else:
        rot = rot.join(weights.select(*keys, "overpass", "w"), "overpass")
    field = (rot.groupBy(*keys, "ia", "ic").agg(F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum(F.col("w") * F.col("n")).alias("wn"))
             .withColumn("f", F.try_divide("ws", "wn")))
    along = F.lit(frame.along_lo) + (F.col("ia") + 0.5) * frame.step
    return (field.groupBy(*keys, "ia").agg((F.avg("f") * frame.width_m).alias("line_density"))
            .withColumn("along", along))


def step_estimate(lines: DataFrame, inverse_wind: DataFrame, keys: Sequence[str] = (), frame: WindFrame = WindFrame()) -> DataFrame:
    """Downwind minus upwind plateau of the line density, and the rate step / mean(1/w) of an inert tracer."""
    keys = list(keys)
    window = lambda lo, hi: F.avg(F.when(F.col("along").between(lo, hi), F.col("line_density")))
    step = lines.groupBy(*keys).agg((window(*frame.downwind) - window(*frame.upwind)).alias("step"))
    joined = join_on(step, inverse_wind, keys) if keys else (
        step.withColumn("__k", F.lit(0)).join(F.broadcast(inverse_wind.withColumn("__k", F.lit(0))), "__k").drop("__k"))
    return joined.withColumn("rate", F.col("step") / F.col("inv_wind"))


def mean_inverse_wind(weights: DataFrame, wind: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of 1/w and of w per replicate or regime."""
    ws = wind.select("overpass", wind_speed("u", "v").alias("ws"))
    return (weights.join(ws, "overpass").groupBy(*keys)
            .agg((F.sum(F.col("w") / F.col("ws")) / F.sum("w")).alias("inv_wind"),
                 (F.sum(F.col("w") * F.col("ws")) / F.sum("w")).alias("mean_wind")))


def locate_source(calm_obs: DataFrame, spec: GridSpec, centre: tuple[float, float], radius_km: float, value: str = "value") -> DataFrame:
    """Pixel with the largest 3-px smoothed calm composite within the radius; ties go to the first pixel."""
    comp = calm_obs.groupBy("iy", "ix").agg(F.avg(value).alias("comp"))
    dense = fill_missing(densify(comp, spec, [], ["comp"]), "comp", "mean")
    smooth = (box_mean(dense, spec, 3, "comp")
              .withColumn("lat", F.lit(spec.lat_top) - F.col("iy") * spec.res)
              .withColumn("lon", F.lit(spec.lon_left) + F.col("ix") * spec.res)
              .where(within_radius("lat", "lon", F.lit(centre[0]), F.lit(centre[1]), radius_km)))
    best = F.max_by(F.struct("iy", "ix", "lat", "lon", "comp"), F.struct("comp", (-F.col("iy")).alias("a"), (-F.col("ix")).alias("b")))
    return smooth.agg(best.alias("s")).select("s.*")
