"""As-of joins: each left row takes the nearest, previous or next right row in time.

No pair of left and right rows is ever formed, and no task sees all rows of a key or of a stretch of time. Both sides are
reduced to distinct times, which are the leaves of a tree of bins, each of 2^22 bins of the level below. Each bin keeps its
first and last match; going down again, what the bins before and after it know is carried into every bin. A window
holds the children of one bin only, so at most 2^22 rows, whatever keys and times are hot. The left rows take the
result of their time by an equi-join with one row per key and time, which adaptive execution splits.

Ties: at equal distance the earlier row wins; of several right rows with one timestamp the one with the largest
`right_order` wins. The tolerance is inclusive. Left rows without a time have no match; NULL keys match NULL keys.
Shuffles: (by, time) of the distinct times, (by, bin) of the non-empty bins of each level, (by, time) of the left rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.calendar import epoch_micros
from skylattice.operators.sizing import join_on, join_rows


def _micros_col(df: DataFrame, ts: str):
    """Timestamps become epoch microseconds; integer columns are taken as they are."""
    return epoch_micros(ts) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts).cast("bigint")


#: Bits of time by which a bin is wider than its children; three levels cover 64 bits.
LEVEL_BITS = 22


def _carried(bins: DataFrame, by: list[str], level: int = 0) -> DataFrame:
    """(by, __k, __prev, __next) for bins (by, __k, __first, __last): the nearest match in smaller and in larger bins of the key."""
    top = (level + 1) * LEVEL_BITS >= 64
    # at the top, times before and after the epoch share one bin
    bins = bins.withColumn("__up", F.shiftright(F.col("__k") + F.lit(1 << LEVEL_BITS - 1).cast("long") if top else F.col("__k"), LEVEL_BITS))
    found = F.col("__last").isNotNull()
    order = Window.partitionBy(*by, "__up")
    before = order.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    after = order.orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = bins.select(*by, "__k", "__up", F.last("__last", ignorenulls=True).over(before).alias("__prev"), F.last("__first", ignorenulls=True).over(after).alias("__next"))
    if top:
        return near.drop("__up")
    ups = bins.groupBy(*by, "__up").agg(F.min_by("__first", F.when(found, F.col("__k"))).alias("__first"), F.max_by("__last", F.when(found, F.col("__k"))).alias("__last"))
    far = _carried(ups.withColumnRenamed("__up", "__k"), by, level + 1).withColumnsRenamed({"__k": "__up", "__prev": "__far_prev", "__next": "__far_next"})
    return (join_on(near, far, [*by, "__up"], "left")
            .select(*by, "__k", F.coalesce("__prev", "__far_prev").alias("__prev"), F.coalesce("__next", "__far_next").alias("__next")))


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: Sequence[str] = (),
              right_cols: Sequence[str] | None = None, right_order: str | None = None,
              direction: str = "nearest", tolerance_s: float | None = None) -> DataFrame:
    """Left-preserving as-of join; `right_cols` of the match are added (NULL when none is close enough)."""
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(direction)
    by = list(by)
    right_cols = list(right_cols or [c for c in right.columns if c not in by and c not in left.columns])

    match = F.struct(F.col("__t").alias("t"), F.struct(*right_cols).alias("p"))
    r = right.withColumn("__t", _micros_col(right, right_ts)).where("__t IS NOT NULL").select(*by, F.col("__t").alias("__k"), match.alias("__m"), F.col(right_order or right_ts).alias("__o"), F.lit(False).alias("__ask"))
    asks = left.withColumn("__k", _micros_col(left, left_ts)).where("__k IS NOT NULL")
    asks = asks.select(*by, "__k", F.lit(None).cast(r.schema["__m"].dataType).alias("__m"), F.lit(None).cast(r.schema["__o"].dataType).alias("__o"), F.lit(True).alias("__ask"))
    # one row for each key and time of either side
    times = r.unionByName(asks).groupBy(*by, "__k").agg(F.max_by("__m", F.when(~F.col("__ask"), F.col("__o"))).alias("__m"), F.any_value("__m", ignoreNulls=True).alias("__any"), F.max("__ask").alias("__ask"))
    # rows whose order is NULL count only where no other is there
    times = times.withColumn("__m", F.coalesce("__m", "__any")).drop("__any")
    found = join_rows(times.where("__ask").select(*by, "__k", "__m"), _carried(times.select(*by, "__k", F.col("__m").alias("__first"), F.col("__m").alias("__last")), by), [*by, "__k"])
    before, after = F.coalesce("__m", "__prev"), F.coalesce("__m", "__next")
    if direction == "backward":
        pick = before
    elif direction == "forward":
        pick = after
    else:
        pick = F.when(after.isNull() | (F.col("__k") - before["t"] <= after["t"] - F.col("__k")), before).otherwise(after)
    found = found.select(*by, F.col("__k").alias("__t"), pick.alias("__pick"))
    if tolerance_s is not None:
        found = found.withColumn("__pick", F.when(F.abs(F.col("__t") - F.col("__pick")["t"]) <= int(round(tolerance_s * 1e6)), F.col("__pick")))
    out = join_rows(left.withColumn("__t", _micros_col(left, left_ts)), found, [*by, "__t"], "left")
    return out.select(*[F.col(c) for c in left.columns], *[F.col("__pick")["p"][c].alias(c) for c in right_cols])


def rounded_hour_join(left: DataFrame, right: DataFrame, left_ts: str, right_hour: str) -> DataFrame:
    """Equi left join on the half-even rounded hour."""
    from skylattice.functions.calendar import round_to_hour

    tagged = left.withColumn("__hour", round_to_hour(left_ts))
    return tagged.join(right, F.col("__hour") == F.col(right_hour), "left").drop("__hour")
