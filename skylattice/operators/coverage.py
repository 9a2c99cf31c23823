"""Coverage and signal reports: newest versions, daily and monthly counts, sampling shares, enhancements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.calendar import month_key
from skylattice.functions.geodesy import haversine_m
from skylattice.functions.values import version_number
from skylattice.operators.quantiles import exact_quantiles
from skylattice.operators.sizing import join_on


def newest_version(df: DataFrame, keys: Sequence[str], version: str, arrival: str) -> DataFrame:
    """One row per key: the numerically largest version; on ties the first arrival.

    A mergeable aggregate, so a key with very many versions is combined on the map side.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(version_number(version).alias("v"), (-F.col(arrival)).alias("a")))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by an explicit order; mergeable like `newest_version`."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), order)
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def daily_counts(df: DataFrame, day: Column, flag: Column, at_least: int = 1) -> DataFrame:
    """Per day: rows, share of rows with the flag (2 decimals), keeping days with enough rows."""
    return (df.groupBy(day.alias("day"))
            .agg(F.count("*").alias("n"), F.round(F.avg(flag.cast("double")), 2).alias("flag_share"))
            .where(F.col("n") >= at_least))


def monthly_usable_days(obs: DataFrame, ts: str, value: str, min_fraction: float, spine: DataFrame) -> DataFrame:
    """Per month of the spine: days with any valid value and days whose valid share reaches the threshold."""
    days = (obs.groupBy(F.to_date(ts).alias("day"))
            .agg(F.count(value).alias("n_valid"), F.count("*").alias("n_all"))
            .withColumn("month", month_key("day")))
    per = days.groupBy("month").agg(
        F.count_if(F.col("n_valid") > 0).alias("days_any"),
        F.count_if(F.col("n_valid") / F.col("n_all") >= min_fraction).alias("days_usable"))
    return spine.join(per, "month", "left").fillna(0, ["days_any", "days_usable"])


def coverage_summary(monthly: DataFrame) -> DataFrame:
    """Median and minimum of usable days over the months, and the months without any."""
    return monthly.agg(F.count("*").alias("n_months"), F.median("days_usable").alias("median_days"),
                       F.min("days_usable").alias("min_days"),
                       F.count_if(F.col("days_usable") == 0).alias("empty_months"))


def month_climatology(daily: DataFrame, ts: str, count: str) -> DataFrame:
    """Mean daily count by calendar month, ordered October first."""
    m = F.month(ts)
    return (daily.groupBy(m.alias("month_no")).agg(F.avg(count).alias("mean_count"))
            .withColumn("season_pos", F.pmod(F.col("month_no") - 10, F.lit(12)).cast("int")))


def share_on_spine(df: DataFrame, part: Column, n: int, start: int = 0) -> DataFrame:
    """Share of rows per value of `part` on the dense spine start..start+n-1; absent values get 0."""
    spine = df.sparkSession.range(start, start + n).select(F.col("id").cast("int").alias("part"))
    counts = df.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n_rows"))
    # at most n rows are left here, so the unpartitioned total is cheap
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy())
    return (spine.join(counts.select("part", share.alias("share")), "part", "left")
            .select("part", F.coalesce("share", F.lit(0.0)).alias("share")))


def enhancement_ratio(zonal: DataFrame, background: DataFrame, season: str, q: float = 0.10) -> DataFrame:
    """Zone mean over the regional low quantile, per season; spread of the zone values is the sample deviation.

    zonal(season, zone, value) holds zone observations, background(season, value) the regional composite pixels.
    """
    bg = exact_quantiles(background, [season], "value", {"background": q})
    zone = zonal.groupBy(season, "zone").agg(F.avg("value").alias("zone_mean"), F.stddev_samp("value").alias("zone_sd"),
                                             F.count("value").alias("n"))
    return join_on(zone, bg, [season], "left").withColumn("ratio", F.col("zone_mean") / F.col("background"))


def urban_excess(obs: DataFrame, distance: Column, window: Column, year: Column, value: str = "value",
                 core_km: float = 10, ring: tuple[float, float] = (35, 45)) -> DataFrame:
    """Mean inside the core minus mean in a rural ring, per year within one calendar window, and the change from
    the first year in percent."""
    inside, rural = distance <= core_km, (distance >= ring[0]) & (distance <= ring[1])
    per = (obs.where(window).groupBy(year.alias("year"))
           .agg(F.avg(F.when(inside, F.col(value))).alias("core_mean"),
                F.avg(F.when(rural, F.col(value))).alias("rural_mean"))
           .withColumn("excess", F.col("core_mean") - F.col("rural_mean")))
    base = F.first("excess").over(Window.partitionBy().orderBy("year"))  # one row per year
    return per.withColumn("change_pct", 100 * F.try_divide(F.col("excess") - base, base))


def displacement_check(points: DataFrame, reference: DataFrame, key: str, limit_m: float = 500.0) -> DataFrame:
    """Great-circle distance between each point and its reference position, flagged beyond the limit."""
    ref = reference.select(key, F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    d = haversine_m("lat", "lon", "ref_lat", "ref_lon")
    return points.join(ref, key, "left").withColumn("distance_m", d).withColumn("displaced", d > limit_m)
