"""Linear least squares over groups through normal equations.

One pass sums the products of regressors and target per group (partial aggregation, no group is gathered); the
small p x p systems, one row per group, are then solved with NumPy inside the tasks that hold those rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.geodesy import across_wind, along_wind
from skylattice.functions.values import column_ppm
from skylattice.operators.materialise import task_slots
from skylattice.operators.sizing import join_on


def product_sums(df: DataFrame, x: Sequence[Column], y: Column, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys, n, xx, xy, yy): row count, packed upper triangle of X'WX, X'Wy and y'Wy."""
    w = F.lit(1.0) if weight is None else weight
    p = len(x)
    cols = df.select(*keys, *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(x)], y.cast("double").alias("__y"),
                     w.cast("double").alias("__w"))
    term = lambda a, b: F.sum(F.col("__w") * F.col(a) * F.col(b))
    xx = F.array(*[term(f"__x{i}", f"__x{j}") for i in range(p) for j in range(i, p)])
    xy = F.array(*[term(f"__x{i}", "__y") for i in range(p)])
    return cols.groupBy(*keys).agg(F.count("*").alias("n"), xx.alias("xx"), xy.alias("xy"), term("__y", "__y").alias("yy"))


def _full(tri: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = tri
    return m + np.triu(m, 1).T


def weighted_least_squares(sums: DataFrame, p: int, keys: Sequence[str]) -> DataFrame:
    """(keys, n, coef, se, chi2): coefficients, standard errors widened by sqrt(max(reduced chi2, 1)).

    Groups whose system is not identifiable (too few rows, collinear regressors) get NULL coefficients.
    """
    keys = list(keys)
    schema = T.StructType([f for f in sums.schema.fields if f.name in keys]
                          + [T.StructField("n", T.LongType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
                             T.StructField("se", T.ArrayType(T.DoubleType())), T.StructField("chi2", T.DoubleType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coef, se, chi = [], [], []
            for n, tri, xy, yy in zip(pdf["n"], pdf["xx"], pdf["xy"], pdf["yy"]):
                a, b = _full(np.asarray(tri), p), np.asarray(xy)
                d = np.sqrt(np.diag(a))
                if n < p or not (d > 0).all() or np.linalg.matrix_rank(a / np.outer(d, d), tol=1e-9) < p:
                    coef.append([None] * p)
                    se.append([None] * p)
                    chi.append(None)
                    continue
                c = np.linalg.solve(a, b)
                chi2 = max(yy - c @ b, 0.0) / max(n - p, 1)
                s = np.sqrt(np.maximum(np.diag(np.linalg.inv(a)) * max(chi2, 1.0), 0.0))
                coef.append(c.tolist())
                se.append(s.tolist())
                chi.append(chi2)
            out = pdf[[*keys, "n"]].copy()
            out["coef"], out["se"], out["chi2"] = coef, se, pd.array(chi, dtype="Float64")
            yield out

    return sums.select(*keys, "n", "xx", "xy", "yy").mapInPandas(solve, schema)


# ---------------------------------------------------------------- plume scaling
def predicted_enhancement(soundings: DataFrame, emitters: DataFrame, keys: Sequence[str], sigma0_km: float = 2.0, spread: float = 0.15) -> DataFrame:
    """Column enhancement (ppm) at each sounding summed over all upwind emitters, however far.

    soundings(keys, x, y, u, v, psurf), emitters(x, y, rate kg/s); positions in km. Emitters at one position are
    summed first; every sounding meets every position in the task that sums them.
    """
    em = emitters.groupBy(F.col("x").alias("ex"), F.col("y").alias("ey")).agg(F.sum("rate").alias("rate"))
    dx, dy = F.col("x") - F.col("ex"), F.col("y") - F.col("ey")
    met = soundings.select(*keys, "x", "y", "u", "v").repartition(task_slots(soundings.sparkSession), *keys).crossJoin(em)
    j = met.select(*keys, "rate", "u", "v", along_wind(dx, dy, "u", "v").alias("al"), across_wind(dx, dy, "u", "v").alias("ac"))
    ws = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    sm = F.sqrt(F.lit(sigma0_km**2) + F.pow(spread * F.col("al"), F.lit(2))) * 1000
    col = F.col("rate") / (ws * F.sqrt(F.lit(2 * np.pi)) * sm) * F.exp(-0.5 * F.pow(F.col("ac") * 1000 / sm, F.lit(2)))
    mass = j.where(F.col("al") > 0).groupBy(*keys).agg(F.sum(col).alias("mass"))
    return (join_on(soundings, mass, list(keys), "left")
            .withColumn("pred_ppm", column_ppm(F.coalesce("mass", F.lit(0.0)), "psurf")).drop("mass"))


def scale_plume(soundings: DataFrame, day: str, y: str = "xco2", unc: str = "xco2_uncertainty", pred: str = "pred_ppm") -> DataFrame:
    """Per day: background, its two gradients and the plume scaling beta with standard errors."""
    x = [F.lit(1.0), F.col("x"), F.col("y"), F.col(pred)]
    sums = product_sums(soundings, x, F.col(y), [day], 1 / (F.col(unc) * F.col(unc)))
    fit = weighted_least_squares(sums, 4, [day])
    return fit.select(day, "n", F.col("coef")[0].alias("background"), F.col("coef")[1].alias("grad_x"), F.col("coef")[2].alias("grad_y"),
                      F.col("coef")[3].alias("beta"), F.col("se")[3].alias("beta_se"), "chi2",
                      F.try_divide(F.col("coef")[3], F.col("se")[3]).alias("snr"))
