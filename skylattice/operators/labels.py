"""Cell-by-season labels from emission maps, with error propagation, and their quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.raster import box_mean, fill_missing, pixel_area_m2
from skylattice.operators.sampling import bilinear_sample
from skylattice.operators.sizing import join_on
from skylattice.settings import SECONDS_PER_YEAR, GridSpec

# kg m-2 s-1 to t km-2 yr-1
TO_T_KM2_YR = 1e6 * SECONDS_PER_YEAR / 1000


def smoothed_samples(maps: DataFrame, spec: GridSpec, cells: DataFrame, cell_id: str, smoothing_px: int, keys: Sequence[str] = (),
                     value: str = "emission") -> DataFrame:
    """(cell, keys, sampled): dense maps with gaps as 0, box-smoothed, bilinear at the cell centres."""
    smooth = box_mean(fill_missing(maps.select(*keys, "iy", "ix", value), value, "zero"), spec, smoothing_px, value, keys)
    return bilinear_sample(cells, smooth, spec, value, [cell_id], keys)


def share_density(maps: DataFrame, totals: DataFrame, spec: GridSpec, cells: DataFrame, cell_id: str, smoothing_px: int = 5,
                  keys: Sequence[str] = (), molar_mass: float = 1.0) -> DataFrame:
    """Each cell's emission density as a fraction of the city total, per m2.

    `totals(keys, total)` uses the same molar-mass convention as `molar_mass`.
    """
    keys = list(keys)
    s = smoothed_samples(maps, spec, cells, cell_id, smoothing_px, keys)
    if keys:
        s = join_on(s, F.broadcast(totals.select(*keys, "total")), keys)  # one row for each map
    else:
        s = s.withColumn("__k", F.lit(0)).join(F.broadcast(totals.select("total").withColumn("__k", F.lit(0))), "__k").drop("__k")
    return s.withColumn("density", F.try_divide(F.col("sampled") * molar_mass, F.col("total"))).drop("sampled", "total")


def city_total(maps: DataFrame, spec: GridSpec, within, molar_mass: float, keys: Sequence[str] = ()) -> DataFrame:
    return maps.where(within).groupBy(*keys).agg((F.sum("emission") * F.lit(pixel_area_m2(spec) * molar_mass)).alias("total"))


def density_with_sd(density: DataFrame, cell_id: str) -> DataFrame:
    """Main density (rep 0) and the deviation over replicates, per cell."""
    return density.groupBy(cell_id).agg(F.max(F.when(F.col("rep") == 0, F.col("density"))).alias("density"),
                                        F.stddev_pop(F.when(F.col("rep") > 0, F.col("density"))).alias("density_sd"))


def assemble(density: DataFrame, seasons: DataFrame, ratio: float, annual_factor: float, out: str = "label") -> DataFrame:
    """One row per (cell, season): label, its propagated error and the annual-mean label.

    density(cell, density, density_sd); seasons(season, e, e_lo, e_hi) is one row per season, attached to each cell
    as a packed array.
    """
    packed = seasons.agg(F.collect_list(F.struct("season", "e", "e_lo", "e_hi")).alias("s")).withColumn("__k", F.lit(0))
    d = (density.withColumn("__k", F.lit(0)).join(F.broadcast(packed), "__k").drop("__k")
         .withColumn("s", F.explode("s")).select("*", "s.*").drop("s"))
    sd_e = (F.col("e_hi") - F.col("e_lo")) / (2 * 1.96)
    lab = F.col("density") * F.col("e") * ratio * TO_T_KM2_YR
    sd = F.hypot(F.col("density_sd") * F.col("e"), F.col("density") * sd_e) * ratio * TO_T_KM2_YR
    return (d.withColumn(out, lab).withColumn(f"{out}_sd", sd).withColumn(f"{out}_annual", F.col(out) / annual_factor)
            .withColumn("share_per_km2", F.col("density") * 1e6).drop("density", "density_sd", "e", "e_lo", "e_hi"))


def zone_season_totals(labels: DataFrame, value: str, season: str = "season", zone: str = "cluster", outside: str = "outside") -> DataFrame:
    """kt per (season, zone), with the subtotal over all zones but the outside, in one grouped pass."""
    inside = F.when(F.col(zone) != outside, F.col(value))
    g = (labels.withColumn("__in", inside).groupingSets([[F.col(season), F.col(zone)], [F.col(season)]], F.col(season), F.col(zone))
         .agg(F.sum(value).alias("__all"), F.sum("__in").alias("__inside"), F.grouping(zone).alias("__g")))
    return g.select(season, F.when(F.col("__g") == 1, "all zones").otherwise(F.col(zone)).alias(zone),
                    (F.when(F.col("__g") == 1, F.col("__inside")).otherwise(F.col("__all")) / 1000).alias("kt"))
