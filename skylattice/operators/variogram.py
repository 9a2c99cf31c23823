"""Semivariograms, their exponential model, and the spatial block size derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.sizing import join_on, join_rows
from skylattice.operators.spatial import lag_sums


def semivariogram(df: DataFrame, z: str, max_km: float = 30.0, lag_km: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lag, h, gamma, n_pairs) for lags with at least one pair; needs columns x, y in km."""
    return (lag_sums(df, z, max_km, lag_km, keys)
            .select(*keys, "lag", ((F.col("lag") + 0.5) * lag_km).alias("h"), (F.col("half_sq") / F.col("n_pairs")).alias("gamma"), "n_pairs"))


def mean_over_draws(variograms: DataFrame) -> DataFrame:
    """Average the semivariance of several fields lag by lag."""
    return variograms.groupBy("lag", "h").agg(F.avg("gamma").alias("gamma"), F.count("*").alias("n_draws"))


def fit_exponential(vario: DataFrame, variance: DataFrame, step: float = 0.5, hi: float = 100.0) -> DataFrame:
    """Non-negative nugget and sill by least squares for each practical range on a 1-D grid; best range kept.

    `variance` is one row with column `sill0`, the unit in which semivariances are fitted. The input has one row
    per lag, so everything after the variogram is a few thousand rows.
    """
    v = (vario.withColumn("__k", F.lit(0)).join(F.broadcast(variance.withColumn("__k", F.lit(0))), "__k").drop("__k")
         .withColumn("g", F.col("gamma") / F.col("sill0")))
    n_grid = round((hi - 0.5) / step) + 1
    v = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1)))).withColumn("range_km", 0.5 + step * F.col("i"))
    v = v.withColumn("e", 1 - F.exp(-3 * F.col("h") / F.col("range_km")))
    s = v.groupBy("range_km", "sill0").agg(F.count("*").cast("double").alias("n"), F.sum("e").alias("se"), F.sum(F.col("e") * F.col("e")).alias("see"),
                                           F.sum("g").alias("sg"), F.sum(F.col("e") * F.col("g")).alias("seg"), F.sum(F.col("g") * F.col("g")).alias("sgg"))
    n, se, see, sg, seg = (F.col(c) for c in ("n", "se", "see", "sg", "seg"))
    sill = F.try_divide(n * seg - se * sg, n * see - se * se)
    nug = (sg - sill * se) / n
    # corner solutions where a coefficient would be negative
    only_sill, only_nug = F.greatest(F.lit(0.0), F.try_divide(seg, see)), F.greatest(F.lit(0.0), sg / n)
    s = s.withColumn("__sill", sill).withColumn("__nug", nug)
    inner = (F.col("__sill") >= 0) & (F.col("__nug") >= 0)
    sse = lambda a, b: F.col("sgg") - 2 * a * sg - 2 * b * seg + n * a * a + 2 * a * b * se + b * b * see
    corner_sill = sse(F.lit(0.0), only_sill) <= sse(only_nug, F.lit(0.0))
    s = (s.withColumn("nug", F.when(inner, F.col("__nug")).when(corner_sill, F.lit(0.0)).otherwise(only_nug))
         .withColumn("sil", F.when(inner, F.col("__sill")).when(corner_sill, only_sill).otherwise(F.lit(0.0))))
    s = s.withColumn("sse", sse(F.col("nug"), F.col("sil")))
    best = F.min_by(F.struct((F.col("nug") * F.col("sill0")).alias("nugget"), (F.col("sil") * F.col("sill0")).alias("sill"), "range_km", "sse"),
                    F.struct("sse", "range_km"))
    return s.agg(best.alias("b")).select("b.*")


def tail_mean(vario: DataFrame, from_km: float) -> DataFrame:
    """Mean semivariance at lags from `from_km` on: the sill of a field without trend."""
    return vario.where(F.col("h") >= from_km).agg(F.avg("gamma").alias("sill0"))


def first_reach(vario: DataFrame, variance: DataFrame, share: float = 0.95) -> DataFrame:
    """First lag whose semivariance reaches the share of the variance, else the last lag."""
    v = vario.withColumn("__k", F.lit(0)).join(F.broadcast(variance.withColumn("__k", F.lit(0))), "__k")
    return v.agg(F.coalesce(F.min(F.when(F.col("gamma") >= share * F.col("sill0"), F.col("h"))), F.max("h")).alias("first_reach_km"))


def block_size(vario: DataFrame, variance: DataFrame, min_km: int = 5) -> DataFrame:
    """One row: fitted range, first lag at 95 % of the variance, and the block size from the larger of both."""
    fit = fit_exponential(vario, variance).withColumn("__k", F.lit(0))
    reach = first_reach(vario, variance).withColumn("__k", F.lit(0))
    return (fit.join(F.broadcast(reach), "__k").drop("__k")
            .withColumn("block_km", F.greatest(F.lit(min_km).cast("bigint"), F.ceil(F.greatest("range_km", "first_reach_km")).cast("bigint"))))


def error_field(replicates: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """Replicate minus main map (rep 0) at each cell."""
    main = replicates.where(F.col("rep") == 0).select(*cell, F.col(value).alias("__main"))
    return (join_rows(replicates.where(F.col("rep") > 0), main, list(cell))
            .withColumn("error", F.col(value) - F.col("__main")).drop("__main"))


def standardised(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(value - mean) / population deviation, per group; statistics are aggregated and joined back."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    if keys:
        j = join_on(df, stats, list(keys))
    else:
        j = df.withColumn("__k", F.lit(0)).join(F.broadcast(stats.withColumn("__k", F.lit(0))), "__k").drop("__k")
    return j.withColumn(value, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")
