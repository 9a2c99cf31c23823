"""Uncertainty propagation by draws for a table of estimates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.hashing import lognormal, standard_normal, uniform


@dataclass(frozen=True)
class Term:
    """One multiplicative error term.

    kind   'lognormal' (a = relative sigma), 'normal' (mean a, sigma b, divided by a), 'inverse_bias' (1 / (1 + N(a, b))),
           'uniform' (divide by U(a, b)), or 'log_interval' (a, b = 95 % interval, as a lognormal of that width)
    a, b   numbers, or names of columns of the estimates table
    """

    name: str
    kind: str
    a: float | str
    b: float | str = 0.0

    def factor(self, seed: int, row_id: str) -> Column:
        a, b = (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (self.a, self.b))
        tag = (seed, F.lit(self.name), F.col(row_id), F.col("draw"))
        if self.kind == "lognormal":
            return lognormal(a, *tag)
        if self.kind == "normal":
            return (a + b * standard_normal(*tag)) / a
        if self.kind == "inverse_bias":
            return 1 / (1 + a + b * standard_normal(*tag))
        if self.kind == "uniform":
            return 1 / (a + (b - a) * uniform(*tag))
        if self.kind == "log_interval":
            return F.exp(standard_normal(*tag) * (F.log(b) - F.log(a)) / F.lit(2 * 1.96))
        raise ValueError(self.kind)


def propagate(estimates: DataFrame, row_id: str, value: str, variants: dict[str, Sequence[Term]], draws: int, seed: int,
              compare: str | None = None) -> DataFrame:
    """Five percentiles of value x all factors per (row, variant); optional test of a comparison value against the
    95 % range. Each (row, variant) group holds exactly `draws` values."""
    # every distinct term is evaluated once per draw and shared by the variants
    terms = {t.name: t for ts in variants.values() for t in ts}
    d = estimates.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    for name, t in terms.items():
        d = d.withColumn(f"__f_{name}", t.factor(seed, row_id))
    results = []
    for label, ts in variants.items():
        product = F.col(value)
        for t in ts:
            product = product * F.col(f"__f_{t.name}")
        results.append(F.struct(F.lit(label).alias("variant"), product.alias("x")))
    keep = [row_id, *([compare] if compare else [])]
    d = d.select(*keep, F.explode(F.array(*results)).alias("r")).select(*keep, "r.*")
    qs = {"p2_5": 0.025, "p16": 0.16, "p50": 0.5, "p84": 0.84, "p97_5": 0.975}
    out = d.groupBy(*keep, "variant").agg(F.percentile("x", F.array(*[F.lit(q) for q in qs.values()])).alias("q"))
    out = out.select(*keep, "variant", *[F.col("q")[i].alias(n) for i, n in enumerate(qs)])
    return out.withColumn("inside_95", F.col(compare).between(F.col("p2_5"), F.col("p97_5"))) if compare else out


def budget_spread(runs: DataFrame, value: str, main: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Relative half range of sensitivity runs about the main run."""
    ref = F.max(F.when(F.col(label) == main, F.col(value)))
    return runs.groupBy(*keys).agg(ref.alias("main"), F.try_divide(F.max(value) - F.min(value), 2 * ref).alias("half_range"))
