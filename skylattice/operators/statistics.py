"""Summary statistics, correlations, audits and skill scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.flux import group_anomaly
from skylattice.operators.quantiles import average_ranks, exact_quantiles
from skylattice.operators.sizing import join_on, join_rows


def melt(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form of the named columns, as doubles."""
    return (df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(list(keep), list(cols), name, value))


def summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), probs: dict[str, float] | None = None) -> DataFrame:
    """Minimum, exact quantiles and maximum per column, one row per (by, column)."""
    probs = {"p1": 0.01, "p50": 0.5, "p99": 0.99} if probs is None else probs
    long = melt(df, by, cols)
    keys = [*by, "column"]
    ends = long.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    return join_on(ends, exact_quantiles(long, keys, "value", probs), keys, "left")


def missing_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL count and share (percent) per column, in one pass."""
    agg = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (agg.unpivot(["__n"], list(cols), "column", "n_missing")
            .select("column", "n_missing", (100.0 * F.col("n_missing") / F.col("__n")).alias("pct_missing")))


def variance_share(df: DataFrame, cell: str, cols: Sequence[str], by_rows: bool = True) -> DataFrame:
    """Variance of the cell means over total variance (both population); NULL for a constant column.

    Each cell's mean counts once per row of the cell or, without `by_rows`, once.
    """
    long = melt(df, [cell], cols).where(F.col("value").isNotNull())
    cells = long.groupBy("column", cell).agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"),
                                             F.var_pop("value").alias("v"))
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / total - mean * mean
    within = F.sum(F.col("n") * F.col("v")) / total
    top = between if by_rows else F.var_pop("m")
    return cells.groupBy("column").agg(F.when(between + within > 0, top / (between + within)).alias("spatial_share"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Value counts with distinct-value total."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Counts in equal bins between minimum and maximum; the last bin is closed."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).withColumn("__k", F.lit(0))
    i = F.floor(F.try_divide((F.col(col) - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    tagged = df.select(F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull()).withColumn("__k", F.lit(0))
    return (tagged.join(F.broadcast(ends), "__k")
            .select(F.least(F.coalesce(i, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi")
            .groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"))
            .select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("left_edge"), "n"))


# ---------------------------------------------------------------- correlation
def ranked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column replaced by its average rank (ties share), NULL where missing."""
    out = df
    for c in cols:
        r = average_ranks(df, [], c, "__r").select(F.col(c).alias("__v"), "__r")
        out = out.hint("merge").join(r, out[c].eqNullSafe(r["__v"]), "left").drop("__v", c).withColumnRenamed("__r", c)
    return out.select(*df.columns)


def pair_correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), out: str = "r") -> DataFrame:
    """Pearson correlation of every column pair over rows where both are present, in one pass."""
    pairs = list(combinations(cols, 2))
    agg = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    names = [f"{a}|{b}" for a, b in pairs]
    return (agg.unpivot(list(keys), names, "__pair", out)
            .select(*keys, F.split_part("__pair", F.lit("|"), F.lit(1)).alias("a"),
                    F.split_part("__pair", F.lit("|"), F.lit(2)).alias("b"), out))


def spearman_pairs(df: DataFrame, cols: Sequence[str], out: str = "rho", complete: bool = False) -> DataFrame:
    """Spearman correlation of every pair (a, b), with ranks over the rows where both are present.

    `complete` shares each column's ranks among its pairs, which is the same where nothing is missing; a NULL then fails the job.
    A pair without common rows is absent.
    """
    if complete:
        full = df.select(*[F.expr(f"coalesce(`{c}`, raise_error('{c} is not complete'))").alias(c) for c in cols])
        return pair_correlations(ranked(full, cols), cols, out=out)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(cols, 2)]
    both = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    for c in ("x", "y"):
        both = join_rows(both, average_ranks(both, ["a", "b"], c, f"r{c}").drop("n"), ["a", "b", c])
    return both.groupBy("a", "b").agg(F.corr("rx", "ry").alias(out))


def source_agreement(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Two sources of the same quantity, one row per name: the median of each and their rank correlation where both are present."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                                         for n, (a, b) in pairs.items()])).alias("p")).select("p.*")
    both = long.where("x IS NOT NULL AND y IS NOT NULL")
    for c in ("x", "y"):
        both = join_rows(both, average_ranks(both, ["name"], c, f"r{c}").drop("n"), ["name", c])
    out = long.select("name").distinct()
    for part in (exact_quantiles(long, ["name"], "x", {"median_first": 0.5}), exact_quantiles(long, ["name"], "y", {"median_second": 0.5}),
                 both.groupBy("name").agg(F.corr("rx", "ry").alias("spearman"))):
        out = join_on(out, part, ["name"], "left")
    return out.select("name", "median_first", "median_second", "spearman")


def strong_pairs(corr: DataFrame, value: str = "rho", at_least: float = 0.8) -> DataFrame:
    return corr.where(F.abs(value) >= at_least)


# ---------------------------------------------------------------- scores
def _r2(y: str, p: str) -> Column:
    n, sst = F.count("*"), F.var_pop(y) * F.count("*")
    return F.when(n > 2, 1 - F.try_divide(F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))), sst))


def skill(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """R2 (more than two pairs), RMSE, MAE and n over complete pairs."""
    e = F.col(y) - F.col(p)
    return (df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys)
            .agg(_r2(y, p).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n_rows")))


def skill_split(df: DataFrame, cell: str, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Overall, spatial (cell means) and temporal (deviations from cell means) R2.

    All three follow from per-cell sums, so the rows are read and shuffled once.
    """
    keys = list(keys)
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    Y, P = F.col(y), F.col(p)
    c = ok.groupBy(*keys, cell).agg(F.count("*").cast("double").alias("n"), F.avg(Y).alias("my"), F.avg(P).alias("mp"),
                                    F.var_pop(Y).alias("vy"), F.var_pop(Y - P).alias("ve"), F.sum(F.abs(Y - P)).alias("sa"))
    n = F.sum("n")
    grand = F.sum(F.col("n") * F.col("my")) / n
    sse_w, sst_w = F.sum(F.col("n") * F.col("ve")), F.sum(F.col("n") * F.col("vy"))
    gap = (F.col("my") - F.col("mp")) * (F.col("my") - F.col("mp"))
    sse = sse_w + F.sum(F.col("n") * gap)
    sst = sst_w + F.sum(F.col("n") * F.col("my") * F.col("my")) - n * grand * grand
    spatial = F.when(F.count("*") > 2, 1 - F.try_divide(F.sum(gap), F.var_pop("my") * F.count("*")))
    return c.groupBy(*keys).agg(F.when(n > 2, 1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(sse / n).alias("rmse"),
                                (F.sum("sa") / n).alias("mae"), spatial.alias("spatial_r2"),
                                F.when(n > 2, 1 - F.try_divide(sse_w, sst_w)).alias("temporal_r2"), n.cast("bigint").alias("n_rows"))


def label_quality(df: DataFrame, y: str, sd: str, keys: Sequence[str] = ()) -> DataFrame:
    """Noise ceiling 1 - mean(sd^2)/var, share of negative labels, median relative uncertainty."""
    keys = list(keys)
    base = df.groupBy(*keys).agg((1 - F.try_divide(F.avg(F.col(sd) * F.col(sd)), F.var_pop(y))).alias("noise_ceiling_r2"),
                                 F.avg((F.col(y) < 0).cast("double")).alias("negative_fraction"), F.count(y).alias("n"))
    rel = df.withColumn("__rel", F.try_divide(F.col(sd), F.abs(y)))
    med = exact_quantiles(rel, keys, "__rel", {"median_relative_sd": 0.5})
    if keys:
        return join_on(base, med, keys, "left")
    return base.withColumn("__k", F.lit(0)).join(F.broadcast(med.withColumn("__k", F.lit(0))), "__k").drop("__k")


def between_within(groups: DataFrame, estimate: str, sigma: str) -> DataFrame:
    """Sample deviation of the group estimates over their mean uncertainty."""
    return groups.agg(F.stddev_samp(estimate).alias("between_sd"), F.avg(sigma).alias("within_sd"),
                      (F.stddev_samp(estimate) / F.avg(sigma)).alias("ratio"))


def inverse_variance(df: DataFrame, est: str, se: str) -> DataFrame:
    """Weighted mean, its standard error, between-group reduced chi-square and the error inflated by it."""
    w = F.try_divide(F.lit(1.0), F.col(se) * F.col(se))
    s = (df.where(F.col(est).isNotNull() & F.col(se).isNotNull())
         .agg(F.sum(w).alias("sw"), F.sum(w * F.col(est)).alias("swb"), F.sum(w * F.col(est) * F.col(est)).alias("swbb"),
              F.count("*").alias("n")))
    beta = F.try_divide("swb", "sw")
    chi2 = F.try_divide(F.col("swbb") - F.col("sw") * beta * beta, F.col("n") - 1)
    se0 = F.try_divide(F.lit(1.0), F.sqrt("sw"))
    return s.select(beta.alias("beta"), se0.alias("beta_se"), chi2.alias("between_chi2"),
                    (se0 * F.greatest(F.lit(1.0), F.sqrt(F.greatest(chi2, F.lit(0.0))))).alias("beta_se_inflated"))


def root_sum_square(budget: DataFrame, sigma: str, keys: Sequence[str] = ()) -> DataFrame:
    return budget.groupBy(*keys).agg(F.sqrt(F.sum(F.col(sigma) * F.col(sigma))).alias("total_rel_sigma"))


__all__ = ["between_within", "group_anomaly", "histogram", "inverse_variance", "label_quality", "melt", "missing_audit",
           "pair_correlations", "ranked", "root_sum_square", "skill", "skill_split", "source_agreement", "spearman_pairs", "strong_pairs",
           "summary", "value_shares", "variance_share"]
