"""Bootstrap weights and interval summaries.

Replicates are a column, never a loop of jobs. Observations are reduced to per-overpass partial sums first, so a
resample costs replicates x overpasses x bins, not replicates x pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.hashing import digest, uniform
from skylattice.operators.quantiles import position_within
from skylattice.operators.sizing import join_on


def multinomial_weights(units: DataFrame, unit: str, reps: int, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, rep, unit, w): how often each unit is drawn in each replicate of n draws with replacement.

    `units` holds one row per unit (overpass, block), per stratum. Units that are not drawn have no row. Units are numbered by
    the order of their digests over buckets of digests, so a stratum with most units is numbered by many tasks.
    """
    if reps < 1:
        raise ValueError("at least one replicate is needed")
    strata = list(strata)
    distinct = units.select(*strata, unit).distinct()
    sizes = distinct.groupBy(*strata).agg(F.count("*").alias("__n"))
    slots = position_within(distinct, strata, digest(unit), unit, "__slot")
    if strata:
        ranked = join_on(slots, sizes, strata)
    else:
        ranked = slots.withColumn("__k", F.lit(0)).join(F.broadcast(sizes.withColumn("__k", F.lit(0))), "__k").drop("__k")
    draws = ranked.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    pick = F.floor(uniform(seed, *strata, "rep", "__slot") * F.col("__n")).cast("int")
    w = (draws.select(*strata, "rep", pick.alias("__slot")).groupBy(*strata, "rep", "__slot")
         .agg(F.count("*").cast("double").alias("w")))
    return join_on(w, ranked.drop("__n"), [*strata, "__slot"]).drop("__slot")


def with_main(weights: DataFrame | None, units: DataFrame, unit: str, strata: Sequence[str] = ()) -> DataFrame:
    """Add replicate 0, in which every unit has weight 1, so estimate and resamples share one job."""
    main = units.select(*strata, unit).distinct().select(*strata, F.lit(0).alias("rep"), unit, F.lit(1.0).alias("w"))
    return main if weights is None else main.unionByName(weights.select(*strata, "rep", unit, "w"))


def interval(reps: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], rel_sd: str | None = None,
             main_cols: Sequence[str] = ()) -> DataFrame:
    """Percentiles over replicates (rep > 0) next to the main estimate and other columns of the main row (rep 0);
    one group holds `reps` rows."""
    boot = F.when(F.col("rep") > 0, F.col(value))
    cols: list[Column] = [F.max(F.when(F.col("rep") == 0, F.col(value))).alias("estimate")]
    cols += [F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c) for c in main_cols]
    cols += [F.percentile(boot, F.lit(p)).alias(n) for n, p in probs.items()]
    if rel_sd:
        cols.append((F.stddev_pop(boot) / F.nullif(F.avg(boot), F.lit(0.0))).alias(rel_sd))
    return reps.groupBy(*keys).agg(*cols)


def paired_block_bootstrap(pred: DataFrame, block: str, y: str, p1: str, p2: str, reps: int, seed: int) -> DataFrame:
    """Resample whole blocks; per replicate the difference of the two columns' R2 (rep 0: the observed one).

    Rows are reduced to per-block sums before any replicate is formed.
    """
    ok = pred.where(F.col(y).isNotNull() & F.col(p1).isNotNull() & F.col(p2).isNotNull())
    sq = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    parts = ok.groupBy(block).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"),
                                  sq(y, p1).alias("e1"), sq(y, p2).alias("e2"))
    w = with_main(multinomial_weights(parts, block, reps, seed), parts, block)
    s = (w.join(parts, block).groupBy("rep")
         .agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "sy", "syy", "e1", "e2")]))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select("rep", ((F.col("e1") - F.col("e2")) / F.nullif(sst, F.lit(0.0))).alias("r2_gain"))
