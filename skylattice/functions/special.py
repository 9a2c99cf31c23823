"""Error-function family and the peaked profile shapes, as whole-stage-generated expressions.

Spark SQL has no erf. The scaled complement exp(z*z)*erfc(z) is smooth in t = 2/(2+z), so a short
Chebyshev interpolant in t (computed here from math.erfc, error below 1e-12) is evaluated by Horner's rule
inside whole-stage codegen.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scaled_erfc(z: float) -> float:
    if z < 5:
        return math.exp(z * z) * math.erfc(z)
    tail = z
    for k in range(60, 0, -1):  # continued fraction, converges fast for large z
        tail = z + k / 2 / tail
    return 1 / (math.sqrt(math.pi) * tail)


def _horner_coefficients(degree: int = 26) -> list[float]:
    def target(s):
        out = []
        for v in np.atleast_1d(s):
            t = (v + 1) / 2
            t = max(t, 1e-9)
            out.append(math.log(_scaled_erfc(2 / t - 2) / t))
        return np.array(out)

    cheb = np.polynomial.chebyshev.chebinterpolate(target, degree)
    return [float(c) for c in np.polynomial.chebyshev.cheb2poly(cheb)]


HORNER = _horner_coefficients()


def _horner(s: str) -> str:
    text = repr(HORNER[-1])
    for c in reversed(HORNER[:-1]):
        text = f"({text} * {s} + {c!r})"
    return text


def with_erfcx(df: DataFrame, z: str, out: str) -> DataFrame:
    """Add exp(z*z) * erfc(z) for a non-negative column z.

    The argument of the polynomial is its own column, so it is computed once per row and the plan stays small.
    """
    s = df.selectExpr("*", f"4D / (2D + {z}) - 1D AS __s")
    return s.selectExpr(*[f"`{c}`" for c in df.columns], f"(__s + 1D) / 2D * exp({_horner('__s')}) AS {out}")


def with_erfc(df: DataFrame, z: str, out: str) -> DataFrame:
    t = with_erfcx(df.selectExpr("*", f"abs({z}) AS __a"), "__a", "__c")
    tail = f"exp(-{z} * {z}) * __c"
    return t.selectExpr(*[f"`{c}`" for c in df.columns], f"CASE WHEN {z} >= 0 THEN {tail} ELSE 2D - {tail} END AS {out}")


def with_emg(df: DataFrame, x: str, x0: str, mu: str, sigma: str, out: str) -> DataFrame:
    """Add the unit-area exponentially modified Gaussian (1/km): decay length x0 behind a source at mu.

    For z > 0 the factor exp(-z*z) is folded into the exponent, so neither factor can overflow.
    """
    t = df.selectExpr("*", f"({sigma} / {x0} - ({x} - {mu}) / {sigma}) / sqrt(2D) AS __z",
                      f"{sigma} * {sigma} / (2D * {x0} * {x0}) - ({x} - {mu}) / {x0} AS __e")
    t = with_erfcx(t.selectExpr("*", "abs(__z) AS __a"), "__a", "__c")
    return t.selectExpr(*[f"`{c}`" for c in df.columns],
                        "CASE WHEN __z > 0 THEN exp(least(__e - __z * __z, 700D)) * __c "
                        f"ELSE exp(least(__e, 700D)) * (2D - exp(-__z * __z) * __c) END / (2D * {x0}) AS {out}")


def exponential_variogram(h: Column, nugget: Column, sill: Column, rng: Column) -> Column:
    return nugget + sill * (1 - F.exp(-3 * h / rng))
