"""Robust outlier fences and overpass usability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.quantiles import exact_quantiles
from skylattice.operators.raster import box_median, densify
from skylattice.operators.sizing import join_on
from skylattice.settings import GridSpec


def _fence(df: DataFrame, keys: Sequence[str], test: str, value: str, k: float) -> DataFrame:
    """Null `value` where `test` lies strictly outside [q1 - k*iqr, q3 + k*iqr] of its group."""
    q = exact_quantiles(df, keys, test, {"__q1": 0.25, "__q3": 0.75})
    iqr = F.col("__q3") - F.col("__q1")
    bad = (F.col(test) < F.col("__q1") - k * iqr) | (F.col(test) > F.col("__q3") + k * iqr)
    return (join_on(df, q, list(keys), "left")
            .withColumn("is_outlier", F.coalesce(bad, F.lit(False)) & F.col(value).isNotNull())
            .withColumn(value, F.when(~F.col("is_outlier"), F.col(value)))
            .drop("__q1", "__q3"))


def iqr_filter(cube: DataFrame, method: str = "temporal", k: float = 3.0, size: int = 7,
               spec: GridSpec | None = None, value: str = "value") -> DataFrame:
    """Null outliers of cube(overpass, iy, ix, value); adds `is_outlier`.

    temporal  each pixel against its own time series
    domain    each pixel against all pixels of its overpass
    local     each pixel's deviation from the size x size median, against all deviations of the overpass;
              needs one row per (overpass, pixel) and the grid `spec`
    """
    if method == "temporal":
        return _fence(cube, ["iy", "ix"], value, value, k)
    if method == "domain":
        return _fence(cube, ["overpass"], value, value, k)
    if method != "local":
        raise ValueError(method)
    if spec is None:
        raise ValueError("the local method needs the grid spec")
    seen = cube.where(F.col(value).isNotNull()).select("overpass").distinct()
    med = exact_quantiles(cube, ["overpass"], value, {"__mid": 0.5})
    dense = densify(cube.join(seen, "overpass", "left_semi"), spec, ["overpass"], [value])
    filled = join_on(dense, med, ["overpass"]).select("overpass", "iy", "ix",
                                                      F.coalesce(value, "__mid").alias("__smooth"))
    smooth = box_median(filled, spec, size, "__smooth", ["overpass"])
    dev = join_on(cube, smooth, ["overpass", "iy", "ix"], "left").withColumn("__dev", F.col(value) - F.col("__smooth"))
    return _fence(dev, ["overpass"], "__dev", value, k).drop("__dev", "__smooth")


def removed_fraction(filtered: DataFrame, value: str = "value") -> DataFrame:
    bad = F.count_if("is_outlier")
    return filtered.agg(bad.alias("n_removed"), (bad / F.nullif(F.count(value) + bad, F.lit(0))).alias("removed_fraction"))


def overpass_coverage(obs: DataFrame, value: str = "value") -> DataFrame:
    """Per overpass: valid pixels, all pixels, valid share and mean value."""
    return (obs.groupBy("overpass")
            .agg(F.count(value).alias("n_valid"), F.count("*").alias("n_all"), F.avg(value).alias("mean_value"))
            .withColumn("valid_fraction", F.col("n_valid") / F.col("n_all")))


def usable_overpasses(obs: DataFrame, min_fraction: float = 0.5, value: str = "value") -> DataFrame:
    """The observations of overpasses whose valid share reaches the threshold."""
    good = overpass_coverage(obs, value).where(F.col("valid_fraction") >= min_fraction).select("overpass")
    return obs.join(good, "overpass", "left_semi")
