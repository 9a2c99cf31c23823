"""Decreasing isotonic regression whose points never meet in one task.

Points in order of x are pooled inside chunks of consecutive ones; pooling the pooled blocks again gives the same fit as
pooling all points at once, so further rounds, with the chunks' borders moved by half a chunk, only merge what is left at
the borders. Two rounds without a merge have looked at every pair of neighbours, and the fit is final. Blocks, not points,
go from round to round.
Shuffles: the points by rank in every round; rounds beyond the first two are needed only where a block grows over a border.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.asof import asof_join
from skylattice.operators.materialise import materialise
from skylattice.operators.quantiles import average_ranks

#: Neighbouring blocks that one task pools at once.
CHUNK = 1 << 16


def pool(x_low: np.ndarray, x_high: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool neighbouring blocks until their means decrease; blocks come in order of x."""
    kept: list[list[float]] = []
    for low, high, w, mean in zip(x_low.tolist(), x_high.tolist(), weight.tolist(), y.tolist(), strict=True):
        while kept and kept[-1][3] <= mean:
            before = kept.pop()
            total = before[2] + w
            low, w, mean = before[0], total, before[3] + (mean - before[3]) * (w / total)
        kept.append([low, high, w, mean])
    return tuple(np.array(c, dtype=float) for c in zip(*kept, strict=True))


def _pool_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("x_low")
    return pd.DataFrame(dict(zip(("x_low", "x_high", "weight", "y"), pool(*(pdf[c].to_numpy() for c in ("x_low", "x_high", "weight", "y"))), strict=True)))


def decreasing_blocks(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(x_low, x_high, weight, y): the blocks of the decreasing fit to points (x, weight, y), one point for each x."""
    blocks = materialise(points.where("x IS NOT NULL AND y IS NOT NULL AND weight > 0")
                         .select(F.col("x").cast("double").alias("x_low"), F.col("x").cast("double").alias("x_high"), F.col("weight").cast("double").alias("weight"), F.col("y").cast("double").alias("y")))
    number, still, shift = blocks.count(), 0, 0
    while number > 1 and still < 2:
        ranks = average_ranks(blocks, [], "x_low", "__rank").select("x_low", "__rank")
        tagged = blocks.hint("merge").join(ranks, "x_low").withColumn("__chunk", F.floor((F.col("__rank") - 1 + shift) / chunk))
        blocks = materialise(tagged.drop("__rank").groupBy("__chunk").applyInPandas(_pool_chunk, "x_low double, x_high double, weight double, y double"))
        # a single chunk needs no second look
        whole = number <= chunk and not shift
        number, last = blocks.count(), number
        still = 2 if whole else still + 1 if number == last else 0
        shift = chunk // 2 - shift
    return blocks


def decreasing_fit(df: DataFrame, y: str, x: str, train: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Add `out`: the decreasing isotonic fit of y on x over the training rows.

    Equal x are averaged with their counts first. Between blocks the fit is interpolated, outside the training range it
    keeps its ends. Rows without x, and all rows where no training row has both values, get NULL.
    """
    number = F.col(x).cast("double")
    known = df.where(train & F.col(y).isNotNull() & number.isNotNull())
    blocks = decreasing_blocks(known.groupBy(number.alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("weight")), chunk)
    ends = blocks.select("y", F.explode(F.array_distinct(F.array("x_low", "x_high"))).alias("x"))
    # ranks of all values are whole numbers in the order of x, which the as-of joins need
    ranks = average_ranks(df.select(number.alias("x")).distinct(), [], "x", "__rank").select("x", F.col("__rank").cast("long").alias("__rank"))
    ends = materialise(ends.hint("merge").join(ranks, "x").select(F.col("__rank").alias("__end"), F.col("x").alias("__x"), F.col("y").alias("__y")))
    values = materialise(ranks)
    for side, direction in (("before", "backward"), ("after", "forward")):
        near = ends.select("__end", F.struct("__x", "__y").alias(side))
        values = asof_join(values, near, "__rank", "__end", right_cols=[side], direction=direction)
    share = (F.col("x") - F.col("before.__x")) / F.nullif(F.col("after.__x") - F.col("before.__x"), F.lit(0.0))
    between = F.col("before.__y") + (F.col("after.__y") - F.col("before.__y")) * F.coalesce(share, F.lit(0.0))
    fit = values.select(F.col("x").alias("__x"), F.coalesce(between, "before.__y", "after.__y").alias(out))
    return df.hint("merge").join(fit, number == F.col("__x"), "left").drop("__x")
