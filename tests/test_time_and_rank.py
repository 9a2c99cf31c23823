from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.functions.hashing import digest
from skylattice.operators.asof import asof_join
from skylattice.operators.quantiles import average_ranks, exact_quantiles, position_within, shuffle_within
from skylattice.operators.sizing import value_bucket

T0 = datetime(2024, 1, 1, 12)


def frame(spark, rows, name):
    return spark.createDataFrame([(i, T0 + d) for i, d in rows], f"{name} int, {name}_ts timestamp_ntz")


def test_asof_ties_and_tolerance(spark):
    m = timedelta(minutes=1)
    left = frame(spark, [(1, 0 * m), (2, 100 * m), (3, 200 * m), (4, 300 * m)], "l")
    right = frame(spark, [(10, -5 * m), (11, 5 * m), (12, -5 * m), (20, 130 * m), (30, 230 * m + timedelta(microseconds=1)), (40, 300 * m)], "r")
    got = {r["l"]: r["r"] for r in asof_join(left, right, "l_ts", "r_ts", right_cols=["r"], right_order="r", tolerance_s=1800).collect()}
    # equal distance: the earlier side, last of its duplicates; exactly 30 minutes matches, a microsecond more does not
    assert got == {1: 12, 2: 20, 3: None, 4: 40}


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("times", ["one key and one bin", "far apart and negative", "one time"])
def test_asof_of_hot_keys_and_times(spark, direction, times):
    rng = np.random.default_rng(5)
    draw = {"one key and one bin": lambda n: rng.integers(0, 60_000, n), "far apart and negative": lambda n: rng.integers(-(1 << 60), 1 << 60, n), "one time": lambda n: np.full(n, 77)}[times]
    l, r = draw(2000).tolist(), sorted(set(draw(500).tolist()))
    left = spark.createDataFrame([(i, t) for i, t in enumerate(l)] + [(-1, None)], "l int, t long")
    right = spark.createDataFrame([(t, i) for i, t in enumerate(r)] + [(None, 9)], "s long, r int")
    df = asof_join(left, right, "t", "s", right_cols=["r"], right_order="r", direction=direction)
    got = {x.l: x.r for x in df.collect()}
    want = {-1: None}
    for i, t in enumerate(l):
        at = np.searchsorted(r, t, side="right") - 1
        prev, nxt = (at if at >= 0 else None), (at if at >= 0 and r[at] == t else at + 1 if at + 1 < len(r) else None)
        near = prev if nxt is None or (prev is not None and t - r[prev] <= r[nxt] - t) else nxt
        want[i] = {"backward": prev, "forward": nxt, "nearest": near}[direction]
    assert got == {k: None if v is None else int(v) for k, v in want.items()}
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the windows and joins are dealt by key and bin; no task gets all rows
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("tol", [None, 900])
def test_asof_against_pandas(spark, direction, tol):
    rng = np.random.default_rng(3)
    l = pd.DataFrame({"k": rng.choice([0, 0, 0, 1, 2], 300), "l_ts": pd.Timestamp(T0) + pd.to_timedelta(rng.integers(0, 86400, 300), "s"), "l": np.arange(300)})
    r = pd.DataFrame({"k": rng.choice([0, 0, 1], 80), "r_ts": pd.Timestamp(T0) + pd.to_timedelta(rng.choice(86400, 80, replace=False), "s"), "r": np.arange(80)})
    want = pd.merge_asof(l.sort_values("l_ts"), r.sort_values("r_ts"), left_on="l_ts", right_on="r_ts", by="k", direction=direction,
                         tolerance=None if tol is None else pd.Timedelta(f"{tol}s"))
    schema = "k int, l_ts timestamp_ntz, l int"
    got = asof_join(spark.createDataFrame(l, schema), spark.createDataFrame(r, "k int, r_ts timestamp_ntz, r int"),
                    "l_ts", "r_ts", by=["k"], right_cols=["r"], right_order="r", direction=direction, tolerance_s=tol).toPandas()
    a = want.sort_values("l").r.fillna(-1).astype(int).tolist()
    assert got.sort_values("l").r.fillna(-1).astype(int).tolist() == a


def test_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.where(rng.random(5000) < 0.4, 0, rng.integers(1, 50, 5000)), "x": np.round(rng.normal(0, 1e-4, 5000), 6)})
    pdf.loc[rng.random(5000) < 0.1, "x"] = None
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.999}).toPandas().set_index("k").sort_index()
    want = pdf.dropna().groupby("k").x.quantile([0.1, 0.5, 0.999]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-18)


def test_quantiles_of_constant_and_whole_table(spark):
    df = spark.range(100).select((F.col("id") - 50).cast("double").alias("x"), F.lit(7.0).alias("c"))
    assert exact_quantiles(df, [], "x", {"q": 0.25}).first()["q"] == -25.25
    assert exact_quantiles(df, [], "c", {"q": 0.9}).first()["q"] == 7.0


def test_quantiles_and_ranks_of_values_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = 95_000 + 20 * rng.random(20_000)
    x[:50] = x[0]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = {"a": 0.001, "b": 0.5, "c": 0.75, "d": 1.0}
    np.testing.assert_allclose(list(exact_quantiles(df, [], "x", probs).first().asDict().values()), np.quantile(x, list(probs.values())), rtol=1e-15)
    got = average_ranks(df, [], "x").toPandas().sort_values("x").avg_rank.to_numpy()
    np.testing.assert_array_equal(got, np.unique(pd.Series(x).rank().to_numpy()))
    # no finer bucket holds more than a small share of the values, though they lie in few coarse ones
    coarse, fine = (df.selectExpr(f"{value_bucket('x', level)} AS b").groupBy("b").count().agg(F.max("count")).first()[0] for level in (1, 2))
    assert coarse > 5_000 and fine < 200


def test_average_ranks(spark):
    x = [3.0, 1.0, 3.0, -2.0, 3.0, 0.0, 1.0, None]
    got = {r["x"]: r["avg_rank"] for r in average_ranks(spark.createDataFrame([(v,) for v in x], "x double"), [], "x").collect()}
    assert got == {-2.0: 1.0, 0.0: 2.0, 1.0: 3.5, 3.0: 6.0}


def test_positions_and_shuffle_keep_every_row(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 2).alias("v"), F.lit("c").alias("w"))
    p = position_within(df, ["k"], digest(F.lit(1), F.col("id")), "id", "p")
    ends = p.groupBy("k").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count_distinct("p").alias("n"))
    assert ends.select("lo", "hi", "n").distinct().collect() == [(0, 999, 1000)]
    s = shuffle_within(df, ["k"], "id", ["v"], 5)
    assert s.count() == 3000 and s.where("v = 2 * id").count() < 100
    assert s.where("v div 2 % 3 <> k").count() == 0 and s.select("v").distinct().count() == 3000
