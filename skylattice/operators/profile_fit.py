"""Batch fits of the peaked line-density profile L(x) = a * f(x; x0, mu, sigma) / 1000 + b + c * x.

Many profiles (regime x replicate x setting) are fitted at once. For a node (x0, mu, sigma) of a coarse grid the
remaining parameters enter linearly, so each node is a closed-form least-squares solve over sums; the best node is
kept and the grid is refined around it. Nodes come from an exploded sequence; sums combine on the map side.
Shuffle per round: the profile points by (profile, node chunk); best nodes by (profile).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.special import with_emg
from skylattice.functions.values import kt_per_year
from skylattice.operators.materialise import materialise, task_slots
from skylattice.operators.sizing import join_on
from skylattice.settings import MOLAR_MASS_NO2

CHUNKS = 8
WIDTH = 1.7
# Search ranges of decay length, source offset and smoothing width (km).
RANGES = {"x0": (2.0, 150.0), "mu": (-15.0, 15.0), "sigma": (1.0, 30.0)}


# Least-squares a, b, c of one (profile, node) from its sums, in deviations from the means.
_FLAT = {"a": "try_divide(fl, ff)", "b": "(sl - a * sf) / n", "c": "0D"}
_SLOPED = {"a": "try_divide(fl * xx - xl * fx, ff * xx - fx * fx)", "c": "try_divide(ff * xl - fx * fl, ff * xx - fx * fx)",
           "b": "(sl - a * sf - c * sx) / n"}


def _round(pts: DataFrame, keys: list[str], sloped: bool, shape: tuple[int, int, int]) -> DataFrame:
    """One grid round: pts(keys, x, l, lo/hi per parameter) to the best node and its parameters per profile."""
    n1, n2, n3 = shape
    # a (profile, node chunk) pair lives in one task: sums need no further shuffle, and few profiles still fill all cores
    size = -(-n1 * n2 * n3 // CHUNKS)
    t = (pts.selectExpr("*", f"explode(sequence(0, {CHUNKS - 1})) AS chunk")
         .repartition(task_slots(pts.sparkSession), *keys, "chunk")
         .selectExpr("*", f"explode(sequence(chunk * {size}, chunk * {size} + {size - 1})) AS node")
         .where(f"node < {n1 * n2 * n3}"))
    # lengths are spaced by a constant ratio, the offset evenly
    t = t.selectExpr("*", f"x0_lo * pow(x0_hi / x0_lo, (node div {n2 * n3}) / {max(n1 - 1, 1)}D) AS x0",
                     f"mu_lo + (mu_hi - mu_lo) * ((node div {n3}) % {n2}) / {max(n2 - 1, 1)}D AS mu",
                     f"sigma_lo * pow(sigma_hi / sigma_lo, (node % {n3}) / {max(n3 - 1, 1)}D) AS sigma")
    t = with_emg(t, "x", "x0", "mu", "sigma", "unit").selectExpr("*", "unit / 1000 AS f")
    bounds = [f"{p}_{s}" for p in RANGES for s in ("lo", "hi")]
    sums = {"n": "cast(count(*) as double)", "sx": "sum(x)", "sxx": "sum(x * x)", "sf": "sum(f)", "sff": "sum(f * f)", "sfx": "sum(f * x)",
            "sl": "sum(l)", "sfl": "sum(f * l)", "sxl": "sum(x * l)", "sll": "sum(l * l)", "l_lo": "min(l)", "l_hi": "max(l)"}
    s = t.groupBy(*keys, "chunk", "node", *bounds, "x0", "mu", "sigma").agg(*[F.expr(e).alias(k) for k, e in sums.items()])
    s = s.selectExpr("*", "sff - sf * sf / n AS ff", "sfl - sf * sl / n AS fl", "sxx - sx * sx / n AS xx", "sfx - sf * sx / n AS fx",
                     "sxl - sx * sl / n AS xl", "sll - sl * sl / n AS sst", "greatest(l_hi - l_lo, 1e-12D) AS span")
    for name, e in (_SLOPED if sloped else _FLAT).items():
        s = s.selectExpr("*", f"{e} AS {name}")
    s = s.selectExpr("*", "greatest(sll - a * sfl - b * sl - c * sxl, 0D) AS sse",
                     "cast(a < 0 OR a > span * 3e5D OR b < l_lo - span OR b > l_hi + span OR abs(c) > span / 50 AS int) AS outside")
    s = s.selectExpr("*", "1 - try_divide(sse, sst) AS r2").where("a IS NOT NULL AND c IS NOT NULL")
    cols = ", ".join(["node", "x0", "mu", "sigma", "a", "b", "c", "sse", "r2", "outside", *bounds])
    return s.groupBy(*keys).agg(F.expr(f"min_by(struct({cols}), struct(outside, sse, node))").alias("__b")).select(*keys, "__b.*")


def fit_profiles(profiles: DataFrame, keys: Sequence[str], x: str = "along", y: str = "line_density", sloped: bool = True,
                 rounds: int = 6, shape: tuple[int, int, int] = (10, 8, 8), along_max: float | None = 45.0) -> DataFrame:
    """Best-fitting parameters, R2 and bound flags for every profile.

    `rounds` = 1 evaluates the coarse grid only; each further round searches
    1.7 steps of the previous grid around the best node, so neighbouring basins stay in reach.
    """
    keys = list(keys)
    base = profiles.where(F.col(y).isNotNull())
    if along_max is not None:
        base = base.where(F.col(x) <= along_max)
    base = base.select(*keys, F.col(x).alias("x"), F.col(y).alias("l"))
    if rounds > 1:
        base = materialise(base)
    pts = base.select("*", *[F.lit(v).alias(f"{p}_{s}") for p, r in RANGES.items() for v, s in zip(r, ("lo", "hi"))])
    best = _round(pts, keys, sloped, shape)
    for _ in range(rounds - 1):
        new = []
        for p, n in zip(RANGES, shape):
            lo, hi, v = F.col(f"{p}_lo"), F.col(f"{p}_hi"), F.col(p)
            if p == "mu":
                step = WIDTH * (hi - lo) / (n - 1)
                a, b = v - step, v + step
            else:
                step = F.pow(hi / lo, F.lit(WIDTH / (n - 1)))
                a, b = v / step, v * step
            new += [F.greatest(F.lit(RANGES[p][0]), a).alias(f"{p}_lo"), F.least(F.lit(RANGES[p][1]), b).alias(f"{p}_hi")]
        best = _round(join_on(base, materialise(best.select(*keys, *new)), keys), keys, sloped, shape)
    near = F.array(*[F.when(F.least(F.col(p) - r[0], r[1] - F.col(p)) < 1e-3 * (r[1] - r[0]), F.lit(p)) for p, r in RANGES.items()])
    return best.select(*keys, "x0", "mu", "sigma", "a", "b", "c", "sse", "r2", F.col("outside").cast("boolean").alias("outside_bounds"),
                       F.array_compact(near).alias("at_bound"))


def emissions(fits: DataFrame, ratio: float = 1.32, wind: str = "mean_wind") -> DataFrame:
    """Lifetime and emission rate from burden a (mol), decay length x0 (km) and mean wind (m/s)."""
    e = (fits.withColumn("tau_h", F.col("x0") * 1000 / F.col(wind) / 3600)
         .withColumn("e_no2_mol_s", F.col("a") / (F.col("tau_h") * 3600))
         .withColumn("e_nox_kg_s", ratio * F.col("e_no2_mol_s") * MOLAR_MASS_NO2))
    return e.withColumn("e_nox_kt_yr", kt_per_year("e_nox_kg_s"))


def choose_constrained(sloped: DataFrame, flat: DataFrame, keys: Sequence[str], min_tau_h: float = 0.6, max_ci_ratio: float = 2.0) -> DataFrame:
    """Keep the sloped-background fit unless it is unconstrained (short lifetime or a wide interval ci_lo, ci_hi);
    then take the flat-background fit. The rejected sloped values stay in `sloped_*`."""
    keys = list(keys)
    cols = [c for c in sloped.columns if c not in keys]
    a = sloped.select(*keys, *[F.col(c).alias(f"sloped_{c}") for c in cols])
    b = flat.select(*keys, *[F.col(c).alias(f"flat_{c}") for c in cols])
    loose = F.coalesce(F.col("sloped_tau_h") < min_tau_h, F.lit(False))
    if "ci_lo" in cols:
        loose = loose | F.coalesce(F.col("sloped_ci_hi") > max_ci_ratio * F.col("sloped_ci_lo"), F.lit(False))
    return (join_on(a, b, keys).withColumn("fallback_flat", loose)
            .select(*keys, "fallback_flat", *[F.when(F.col("fallback_flat"), F.col(f"flat_{c}")).otherwise(F.col(f"sloped_{c}")).alias(c) for c in cols],
                    F.col("sloped_tau_h"), F.col("sloped_e_nox_kg_s")))


def settings_spread(fits: DataFrame, value: str, reference: float | Column, r2: str = "r2") -> DataFrame:
    """Spread of an estimate over fit settings: all fits, and the fits that reached the best R2 within 1e-6."""
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    from pyspark.sql import Window

    top = F.max(r2).over(Window.partitionBy())  # one row per setting
    ok = F.col("__top") - F.col(r2) <= 1e-6
    return (fits.withColumn("__top", top)
            .agg(F.count("*").alias("n_fits"), ((F.max(value) - F.min(value)) / F.first(ref)).alias("spread_all"),
                 F.count_if(ok).alias("n_converged"),
                 ((F.max(F.when(ok, F.col(value))) - F.min(F.when(ok, F.col(value)))) / F.first(ref)).alias("spread_converged")))
