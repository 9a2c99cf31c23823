"""Inventory tables (species, year, sector, lat, lon, value): region totals, ratios, mixing and re-split scenarios."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.values import clip, safe_ratio
from skylattice.operators.sizing import join_on


def region_fraction(grid: DataFrame, res: float, inside: Callable[[Column, Column], Column], per_side: int = 10) -> DataFrame:
    """(lat, lon, fraction): share of each grid cell inside a region, by per_side x per_side sub-points.

    `inside` is a function (lat, lon) -> boolean Column, so any zone predicate can be passed.
    """
    offs = F.transform(F.sequence(F.lit(0), F.lit(per_side * per_side - 1)), lambda k: F.struct(
        (((k % per_side) + 0.5) / per_side - 0.5).alias("a"), ((F.floor(k / per_side) + 0.5) / per_side - 0.5).alias("b")))
    pts = grid.select("lat", "lon").distinct().withColumn("o", F.explode(offs))
    hit = inside(F.col("lat") + F.col("o.a") * res, F.col("lon") + F.col("o.b") * res)
    return pts.groupBy("lat", "lon").agg(F.avg(hit.cast("double")).alias("fraction"))


def region_totals(inventory: DataFrame, res: float, inside: Callable[[Column, Column], Column], keys: Sequence[str], value: str = "value",
                  per_side: int = 10, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Sum of value x share of its cell inside the region.

    Cells are integer keys of the lattice of spacing `res` whose lines run through `origin` (lat, lon), and they come from the rows
    themselves: no row is lost to a list of cells or to the last bit of a coordinate. Coordinates may lie anywhere in their
    cell. A row with a value but without finite coordinates fails the job; missing values count nothing. Values are
    summed per cell before the shares join.
    """
    lost = F.col(value).isNotNull() & ~F.coalesce((F.abs("lat") < 1e9) & (F.abs("lon") < 1e9), F.lit(False))
    index = lambda c, o: F.when(lost, F.raise_error(F.lit("an inventory row has a value but no place"))).otherwise(F.floor((F.col(c) - o) / res))
    placed = inventory.withColumn("__i", index("lat", origin[0])).withColumn("__j", index("lon", origin[1]))
    cell = placed.groupBy(*keys, "__i", "__j").agg(F.sum(value).alias("v"))
    centre = lambda c, o: (F.col(c) + 0.5) * res + o
    grid = placed.select("__i", "__j").where("__i IS NOT NULL AND __j IS NOT NULL").distinct().select(centre("__i", origin[0]).alias("lat"), centre("__j", origin[1]).alias("lon"))
    share = region_fraction(grid, res, inside, per_side).select(F.floor((F.col("lat") - origin[0]) / res).alias("__i"),
                                                                F.floor((F.col("lon") - origin[1]) / res).alias("__j"), "fraction")
    return cell.join(share, ["__i", "__j"]).groupBy(*keys).agg(F.sum(F.col("v") * F.col("fraction")).alias("total"))


def annual_ratios(totals: DataFrame, num: str, den: str, year: str = "year") -> DataFrame:
    """Per-year ratio of two species totals."""
    wide = totals.groupBy(year).agg(F.sum(F.when(F.col("species") == num, F.col("total"))).alias("num"),
                                    F.sum(F.when(F.col("species") == den, F.col("total"))).alias("den"))
    return wide.withColumn("ratio", safe_ratio("num", "den"))


def ratio_spread(annual: DataFrame) -> DataFrame:
    return annual.agg(F.avg("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("sd_ratio"),
                      (F.stddev_pop("ratio") / F.nullif(F.avg("ratio"), F.lit(0.0))).alias("rel_sd"))


def sector_table(totals: DataFrame, num: str, den: str, tracer: str, den_min: float = 1.0, num_min: float = 100.0) -> DataFrame:
    """One row per sector with its totals, its ratio (NULL for a negligible denominator) and its tracer ratio;
    sectors negligible in both are dropped, as defined for the comparison table."""
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("species") == s, F.col("total"))), F.lit(0.0))
    wide = totals.groupBy("sector").agg(pick(den).alias("den"), pick(num).alias("num"), pick(tracer).alias("tracer"))
    return (wide.where((F.col("den") > den_min) | (F.col("num") > num_min))
            .withColumn("ratio", safe_ratio("num", "den", den_min)).withColumn("tracer_ratio", safe_ratio("tracer", "den", den_min)))


def adjusted_ratio(sectors: DataFrame, without_counterpart: Sequence[str]) -> DataFrame:
    """Ratio after removing from the denominator the sectors that have no counterpart in the numerator."""
    off = F.coalesce(F.sum(F.when(F.col("sector").isin(*without_counterpart), F.col("den"))), F.lit(0.0))
    return sectors.agg((F.sum("num") / (F.sum("den") - off)).alias("adjusted_ratio"))


def two_group_mix(sectors: DataFrame, observed: float | Column, den_min: float = 100.0) -> DataFrame:
    """Sectors split by their tracer ratio against the overall one; the observed ratio gives the share of the
    high group (clipped to [0, 1]) and the mixed num:den ratio. One row out."""
    obs = observed if isinstance(observed, Column) else F.lit(float(observed))
    overall = F.sum("tracer").over(Window.partitionBy()) / F.sum("den").over(Window.partitionBy())  # one row per sector
    s = sectors.withColumn("__all", overall)
    high = F.coalesce((F.col("den") > den_min) & (F.col("tracer_ratio") > F.col("__all")), F.lit(False))
    side = lambda c, h: F.sum(F.when(high == F.lit(h), F.col(c)).otherwise(0.0))
    g = s.agg(*[side(c, h).alias(f"{c}_{n}") for c in ("den", "num", "tracer") for h, n in ((True, "high"), (False, "low"))])
    for n in ("high", "low"):
        g = (g.withColumn(f"t_{n}", F.try_divide(F.col(f"tracer_{n}"), F.col(f"den_{n}")))
             .withColumn(f"q_{n}", F.try_divide(F.col(f"num_{n}"), F.col(f"den_{n}"))))
    alpha = F.try_divide(obs - F.col("t_low"), F.col("t_high") - F.col("t_low"))
    return (g.withColumn("alpha", alpha).withColumn("share_high", clip(F.col("alpha"), 0.0, 1.0))
            .withColumn("mixed_ratio", F.col("share_high") * F.col("q_high") + (1 - F.col("share_high")) * F.col("q_low"))
            .select("t_high", "t_low", "q_high", "q_low", (F.col("den_high") / (F.col("den_high") + F.col("den_low"))).alias("inventory_share_high"),
                    "alpha", "share_high", "mixed_ratio"))


def pair_resplit(sectors: DataFrame, pairs: Sequence[tuple[str, str]], targets: Sequence[float]) -> DataFrame:
    """Scenario table: re-split one sector pair so that the overall tracer ratio meets each target, all other
    shares fixed; fraction of the first sector, feasibility and the resulting num:den ratio."""
    total = F.sum("den").over(Window.partitionBy())  # one row per sector
    s = (sectors.where(F.col("den") > 1)
         .select("sector", (F.col("den") / total).alias("share"), F.coalesce("tracer_ratio", F.lit(0.0)).alias("cr"), (F.col("num") / F.col("den")).alias("q")))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(t)).alias("target")) for a, b in pairs for t in targets])
    s = s.withColumn("p", F.explode(rows)).select("*", "p.*").drop("p")
    at = lambda c, k: F.sum(F.when(F.col("sector") == F.col(k), F.col(c)))
    fixed = ~(F.col("sector").eqNullSafe(F.col("a")) | F.col("sector").eqNullSafe(F.col("b")))
    rest = lambda c: F.coalesce(F.sum(F.when(fixed, F.col("share") * F.col(c))), F.lit(0.0))
    g = s.groupBy("a", "b", "target").agg((at("share", "a") + at("share", "b")).alias("pool"), at("share", "a").alias("share_a"), at("cr", "a").alias("cr_a"),
                                          at("cr", "b").alias("cr_b"), at("q", "a").alias("q_a"), at("q", "b").alias("q_b"),
                                          rest("cr").alias("fixed_cr"), rest("q").alias("fixed_q"))
    f = F.try_divide((F.col("target") - F.col("fixed_cr")) / F.col("pool") - F.col("cr_b"), F.col("cr_a") - F.col("cr_b"))
    g = g.withColumn("fraction_a", f).withColumn("__c", clip(F.col("fraction_a"), 0.0, 1.0))
    return g.select("a", "b", "target", "fraction_a", F.col("fraction_a").between(0, 1).alias("feasible"), (F.col("share_a") / F.col("pool")).alias("inventory_fraction_a"),
                    (F.col("fixed_q") + F.col("pool") * (F.col("__c") * F.col("q_a") + (1 - F.col("__c")) * F.col("q_b"))).alias("ratio"))


def feasible_range(scenarios: DataFrame) -> DataFrame:
    ok = lambda agg: agg(F.when(F.col("feasible"), F.col("ratio")))
    return scenarios.agg(ok(F.min).alias("ratio_lo"), ok(F.max).alias("ratio_hi"), ok(F.avg).alias("ratio_mean"), F.count_if("feasible").alias("n_feasible"))


def share_of_total(zone: DataFrame, total_zone: str, keys: Sequence[str] = (), value: str = "total", rate: float | None = None) -> DataFrame:
    """Each zone's share of the named zone's total, and the share times a city rate."""
    keys = list(keys)
    ref = zone.where(F.col("zone") == total_zone).select(*keys, F.col(value).alias("__t"))
    if keys:
        z = join_on(zone, ref, keys)
    else:
        z = zone.withColumn("__k", F.lit(0)).join(F.broadcast(ref.withColumn("__k", F.lit(0))), "__k").drop("__k")
    z = z.withColumn("share", F.try_divide(F.col(value), F.col("__t"))).drop("__t")
    return z if rate is None else z.withColumn("zone_rate", F.col("share") * rate)


def clamped_lookup(df: DataFrame, table: DataFrame, key: str, last: int, value: str, fallback: Column | None = None) -> DataFrame:
    """Value at the key clamped to its last available year; rows without a match use a second key (`fallback`)."""
    first = df.withColumn("__k1", F.least(F.col(key), F.lit(last)))
    t1 = table.select(F.col(key).alias("__k1"), F.col(value).alias("__v1"))
    j = first.join(t1, "__k1", "left").drop("__k1")
    if fallback is None:
        return j.withColumnRenamed("__v1", value)
    t2 = table.select(F.col(key).alias("__k2"), F.col(value).alias("__v2"))
    j = j.withColumn("__k2", fallback).join(t2, "__k2", "left").drop("__k2")
    return j.withColumn(value, F.coalesce("__v1", "__v2")).drop("__v1", "__v2")
