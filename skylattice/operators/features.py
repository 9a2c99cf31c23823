"""The cell-by-month feature table and its season means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.calendar import month_key
from skylattice.functions.geodesy import wind_from_deg
from skylattice.functions.hashing import digest
from skylattice.operators.sizing import join_on


class DuplicateKeys(ValueError):
    """A side of a left join would multiply rows."""


def unique_on(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """The table itself, with a runtime check per key that it holds one row."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in df.columns if c not in keys])
    ok = F.assert_true(F.col("__n") == 1, F.lit(f"{name} has several rows for one key"))
    return counted.where(ok.isNull()).select(*df.columns)


def assemble(base: DataFrame, layers: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Chain of left joins at mixed grains; every layer is checked to be unique on its keys, so rows never multiply.

    Join sides are left to adaptive execution, which sees each layer's real size after its uniqueness check.
    """
    out = base
    for layer, keys in layers:
        out = join_on(out, unique_on(layer, keys), list(keys), "left")
    return out


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The table with a runtime assertion that none of the columns is NULL."""
    bad = None
    for c in cols:
        bad = F.col(c).isNull() if bad is None else bad | F.col(c).isNull()
    return df.where(F.assert_true(~bad, F.lit("missing features after the join")).isNull())


def prefer(df: DataFrame, primary: DataFrame | None, fallback: DataFrame | None, key: str, cols: Sequence[str], prefix: str = "alt_") -> DataFrame:
    """Layer from the primary source, or from the fallback when there is no primary; with both, the fallback stays
    as cross-check columns."""
    if primary is not None:
        out = df.join(primary.select(key, *cols), key, "left")
        if fallback is not None:
            out = out.join(fallback.select(key, *[F.col(c).alias(prefix + c) for c in cols]), key, "left")
        return out
    if fallback is not None:
        return df.join(fallback.select(key, *cols), key, "left")
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in cols])


def weather_by_month(met: DataFrame, ts: str, u: str = "u", v: str = "v", blh: str = "blh", sector: tuple[float, float] = (45.0, 180.0)) -> DataFrame:
    """Mean speed and boundary layer, direction of the mean wind vector, share of hours with wind from the sector."""
    d = wind_from_deg(u, v)
    hit = ((d >= sector[0]) & (d < sector[1])).cast("double")
    g = met.groupBy(month_key(ts).alias("month")).agg(
        F.avg(F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))).alias("ws850"), F.avg(blh).alias("blh_m"),
        F.avg(u).alias("__u"), F.avg(v).alias("__v"), F.avg(hit).alias("frac_ese"))
    return g.withColumn("wd850", wind_from_deg("__u", "__v")).drop("__u", "__v")


def season_means(features: DataFrame, cols: Sequence[str], direction: str = "wd850", keys: Sequence[str] = ("cell_id", "season")) -> DataFrame:
    """Means over the months of each (cell, season); the direction is averaged as a unit vector and renormalised."""
    rad = F.radians(direction)
    g = features.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols], F.avg(F.sin(rad)).alias("__s"), F.avg(F.cos(rad)).alias("__c"),
                                    F.count("*").alias("n_months"))
    norm = F.nullif(F.hypot("__s", "__c"), F.lit(0.0))
    return (g.withColumn(f"{direction}_sin", F.col("__s") / norm).withColumn(f"{direction}_cos", F.col("__c") / norm).drop("__s", "__c"))


def cell_summary(model: DataFrame, label: str, others: Sequence[str], cell: str = "cell_id") -> DataFrame:
    """Mean label per cell with the cell's constant columns."""
    return model.groupBy(cell).agg(F.avg(label).alias(label), *[F.any_value(c).alias(c) for c in others])


def spot_check(df: DataFrame, key: Column, n: int = 8, seed: int = 42) -> DataFrame:
    """Reproducible sample of n rows by seeded hash of the key."""
    return df.withColumn("__h", digest(seed, key)).orderBy("__h").limit(n).drop("__h")


def top_per_group(df: DataFrame, group: str, by: Column, n: int) -> DataFrame:
    """The n rows with the largest `by` per group, for summary-sized tables."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(group).orderBy(by.desc(), *[F.col(c) for c in df.columns if c != group]))
    return df.withColumn("rank", rn).where(F.col("rank") <= n)
