"""Exact quantiles, ranks and positions that never gather a whole group in one task.

A group (one pixel, one overpass, the whole table) may hold a large share of all rows. So every operator here
first counts rows per (group, value bucket), with partial aggregation on the map side, and runs its window over
that histogram only. The members of the few buckets that contain the answer are counted by finer buckets in the same
way, and the exact answer needs the members of those only, after identical values have been counted together.

Shuffles: (keys, bucket) counts; counts of the wanted buckets only, twice; (keys) of one row per probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.sizing import join_on, join_rows, value_bucket


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _q(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def _over(keys: Sequence[str], order: str | None = None) -> str:
    part = f"PARTITION BY {_q(keys)} " if keys else ""
    return f"OVER ({part}ORDER BY {order} {RUNNING})" if order else f"OVER ({part})"


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group: linearly interpolated quantiles, one column per entry of `probs`.

    NULL and NaN values are ignored; groups without any value are absent.
    """
    keys = list(keys)
    k = [f"`{c}`" for c in keys]
    v = (df.selectExpr(*k, f"cast(`{value}` AS double) AS __v").where("__v IS NOT NULL AND NOT isnan(__v)")
         .selectExpr("*", f"{value_bucket('__v')} AS __b"))
    hist = (v.groupBy(*keys, "__b").agg(F.expr("count(*) AS __n"))
            .selectExpr(*k, "__b", "__n", f"sum(__n) {_over(keys)} AS __total", f"sum(__n) {_over(keys, '__b')} - __n AS __before"))

    def rank(p: float, up: bool) -> str:
        return f"cast({'ceil' if up else 'floor'}({float(p)!r}D * (__total - 1)) AS bigint)"

    wanted = ", ".join(rank(p, up) for p in probs.values() for up in (False, True))
    here = "r -> r >= __before AND r < __before + __n"
    targets = hist.selectExpr(*k, "__b", "__total", "__before", f"filter(array_distinct(array({wanted})), {here}) AS __ranks").where("size(__ranks) > 0")
    # values far from zero may share one bucket: its members are counted by finer buckets before any value is sorted
    fine = (join_on(v, targets, [*keys, "__b"]).selectExpr("*", f"{value_bucket('__v', 2)} AS __f")
            .groupBy(*keys, "__b", "__f", "__total", "__before", "__ranks").agg(F.expr("count(*) AS __n"))
            .selectExpr(*k, "__f", "__total", "__ranks", "__n", f"__before + sum(__n) {_over([*keys, '__b'], '__f')} - __n AS __before")
            .selectExpr(*k, "__f", "__total", "__before", f"filter(__ranks, {here}) AS __ranks").where("size(__ranks) > 0"))
    members = (join_on(v.selectExpr(*k, "__v", f"{value_bucket('__v', 2)} AS __f"), fine, [*keys, "__f"])
               .groupBy(*keys, "__f", "__v", "__total", "__before", "__ranks").agg(F.expr("count(*) AS __c")))
    picked = (members.selectExpr("*", f"__before + sum(__c) {_over([*keys, '__f'], '__v')} AS __last")
              .selectExpr(*k, "__total", "__v", "explode(filter(__ranks, r -> r >= __last - __c AND r < __last)) AS __rank"))
    sides = [F.expr(f"max(CASE WHEN __rank = {rank(p, up)} THEN __v END) AS __{'hi' if up else 'lo'}{i}")
             for i, p in enumerate(probs.values()) for up in (False, True)]
    pos = [f"({float(p)!r}D * (__total - 1))" for p in probs.values()]
    return picked.groupBy(*keys, "__total").agg(*sides).selectExpr(
        *k, *[f"__lo{i} + (__hi{i} - __lo{i}) * ({q} - floor({q})) AS `{name}`" for i, (name, q) in enumerate(zip(probs, pos))])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """(keys, value, n, rank): one row per distinct value with the mean 1-based rank of its ties."""
    keys = list(keys)
    k = [f"`{c}`" for c in keys]
    number = f"cast(`{value}` AS double)"
    counts = (df.where(f"`{value}` IS NOT NULL").groupBy(*keys, value).agg(F.expr("count(*) AS n"))
              .selectExpr("*", f"{value_bucket(number)} AS __b", f"{value_bucket(number, 2)} AS __f"))
    fine = counts.groupBy(*keys, "__b", "__f").agg(F.expr("sum(n) AS __n"))
    hist = (fine.groupBy(*keys, "__b").agg(F.expr("sum(__n) AS __m"))
            .selectExpr(*k, "__b", f"sum(__m) {_over(keys, '__b')} - __m AS __before"))
    # ranks before each finer bucket: those before its bucket and those of its earlier siblings
    fine = (join_rows(fine, hist, [*keys, "__b"])
            .selectExpr(*k, "__f", f"__before + sum(__n) {_over([*keys, '__b'], '__f')} - __n AS __before"))
    joined = join_rows(counts, fine, [*keys, "__f"])
    return (joined.selectExpr("*", f"__before + sum(n) {_over([*keys, '__f'], f'`{value}`')} AS __upto")
            .selectExpr(*k, f"`{value}`", "n", f"__upto - (n - 1) / 2 AS `{out}`"))


def position_within(df: DataFrame, keys: Sequence[str], order_hash: Column, tie: str, out: str) -> DataFrame:
    """0-based position in hash order inside each group, computed over hash buckets in parallel.

    `order_hash` is a hex digest; its first three digits split even one giant group into 4,096 equal pieces, so no window
    ever sees a whole group, and many groups of some thousand rows each have fewer pieces than rows.
    """
    keys = list(keys)
    tagged = df.withColumn("__h", order_hash).selectExpr("*", "substring(__h, 1, 3) AS __b")
    hist = (tagged.groupBy(*keys, "__b").agg(F.expr("count(*) AS __n"))
            .selectExpr(*[f"`{c}`" for c in keys], "__b", f"sum(__n) {_over(keys, '__b')} - __n AS __before"))
    here = f"row_number() OVER (PARTITION BY {_q([*keys, '__b'])} ORDER BY __h, `{tie}`) - 1"
    return (join_rows(tagged, hist, [*keys, "__b"]).selectExpr("*", f"cast(__before + {here} AS bigint) AS `{out}`")
            .drop("__h", "__b", "__before"))


def shuffle_within(df: DataFrame, keys: Sequence[str], id_col: str, cols: Sequence[str], seed) -> DataFrame:
    """Permute `cols` (together) between the rows of each group; `id_col` and all other columns stay.

    Equal on every run: row i in id-hash order receives the values of row i in seeded-hash order.
    """
    from skylattice.functions.hashing import digest

    keys = list(keys)
    rest = [c for c in df.columns if c not in cols]
    receivers = position_within(df.select(*rest), keys, digest(id_col), id_col, "__p")
    donors = position_within(df.select(*keys, id_col, *cols), keys, digest(F.lit(seed), F.lit("donor"), F.col(id_col)),
                             id_col, "__p").drop(id_col)
    return join_rows(receivers, donors, [*keys, "__p"]).drop("__p").select(*df.columns)
