"""From the rate at observation time to an annual mean: hour, weekday and month profiles against the sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.sizing import join_on


def wide_to_long(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """h1..h24 style columns to rows with a 0-based position."""
    pairs = F.array(*[F.struct(F.lit(i).alias(name), F.col(c).cast("double").alias(value)) for i, c in enumerate(cols)])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, f"__p.{name}", f"__p.{value}")


def profile_by_prefix(profiles: DataFrame, prefixes: DataFrame, owners: tuple[str, str]) -> DataFrame:
    """Monthly shares per activity code: profiles whose class code starts with one of the code's prefixes, the latest
    year of each activity (smallest class on ties), normalised, averaged; the first owner's rows win over the second's.

    profiles(owner, activity, klass, year, month, value), one value per key; prefixes(code, prefix). The prefix table is a small
    constant list, joined on
    the equal leading characters; every leading part of a class is tried.
    """
    heads = F.expr("transform(sequence(1, greatest(1, length(klass))), n -> substring(klass, 1, n))")
    tagged = profiles.withColumn("prefix", F.explode(F.array_distinct(heads)))
    hit = tagged.join(prefixes, "prefix").where(F.col("klass").startswith(F.col("prefix")))
    hit = hit.dropDuplicates(["code", "owner", "activity", "klass", "year", "month"])
    latest = (hit.groupBy("code", "owner", "activity").agg(F.min(F.struct((-F.col("year")).alias("y"), "klass")).alias("__l"))
              .select("code", "owner", "activity", (-F.col("__l.y")).alias("year"), F.col("__l.klass").alias("klass")))
    cur = join_on(hit, latest, ["code", "owner", "activity", "year", "klass"])
    norm = cur.groupBy("code", "owner", "activity").agg(F.sum("value").alias("__s"))
    shape = join_on(cur, norm, ["code", "owner", "activity"]).withColumn("f", F.try_divide("value", "__s"))
    per = shape.groupBy("code", "month").agg(*[F.avg(F.when(F.col("owner") == o, F.col("f"))).alias(n) for o, n in zip(owners, ("own", "region"))])
    return per.select("code", "month", F.coalesce("own", "region").alias("month_share"))


def sampling_shares(obs: DataFrame, local_ts: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shares of observations by clock hour, weekday (0 = Monday) and month. All three come from one grouped pass."""
    base = obs.select(F.hour(local_ts).alias("hour"), F.weekday(local_ts).alias("dow"), F.month(local_ts).alias("month_no"))
    cube = base.groupBy("hour", "dow", "month_no").agg(F.count("*").alias("n"))  # at most 24 x 7 x 12 rows

    def shares(col: str, name: str) -> DataFrame:
        from pyspark.sql import Window

        g = cube.groupBy(col).agg(F.sum("n").alias("n"))
        return g.select(col, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    return shares("hour", "w_hour"), shares("dow", "w_dow"), shares("month_no", "w_month")


def representativeness(sectors: DataFrame, hourly: DataFrame, weekly: DataFrame, monthly: DataFrame, hours: DataFrame,
                       dows: DataFrame, months: DataFrame, flat: Sequence[str] = ()) -> DataFrame:
    """(variant, factor): sum over sectors of weight x f_hour x f_week x f_month, weights renormalised.

    sectors(sector, weight); hourly(sector, month_no, dow, hour, value); weekly(sector, dow, factor);
    monthly(sector, month_no, month_share); `flat` lists the sectors whose month factor is 1 in the second variant.
    All inputs are profile-sized (hours x weekdays x months per sector).
    """
    k3 = ["sector", "month_no", "dow"]
    day = hourly.join(hours, "hour", "left").groupBy(*k3).agg(
        (F.sum(F.col("value") * F.coalesce("w_hour", F.lit(0.0))) / F.sum("value") * 24).alias("f"))
    f_hour = (day.join(dows, "dow").join(months, "month_no").groupBy("sector")
              .agg(F.sum(F.col("w_month") * F.col("w_dow") * F.col("f")).alias("f_hour")))
    f_week = (sectors.select("sector").withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
              .join(dows, "dow", "left").join(weekly, ["sector", "dow"], "left").groupBy("sector")
              .agg(F.when(F.count("factor") > 0, F.sum(F.coalesce("w_dow", F.lit(0.0)) * F.coalesce("factor", F.lit(1 / 7)) * 7)).otherwise(1.0).alias("f_week")))
    f_month = (monthly.join(months, "month_no").groupBy("sector").agg(F.sum(F.col("w_month") * F.col("month_share") * 12).alias("f_month")))
    s = (sectors.join(f_hour, "sector").join(f_week, "sector", "left").join(f_month, "sector", "left")
         .withColumn("f_month", F.coalesce("f_month", F.lit(1.0))))
    is_flat = F.col("sector").isin(*flat) if flat else F.lit(False)
    variants = F.array(F.struct(F.lit("profiles").alias("variant"), F.col("f_month").alias("fm")),
                       F.struct(F.lit("flat months").alias("variant"), F.when(is_flat, 1.0).otherwise(F.col("f_month")).alias("fm")))
    s = s.withColumn("v", F.explode(variants))
    return s.groupBy("v.variant").agg((F.sum(F.col("weight") * F.col("f_hour") * F.col("f_week") * F.col("v.fm")) / F.sum("weight")).alias("factor"))
