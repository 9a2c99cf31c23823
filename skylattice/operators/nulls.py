"""Structured null maps: rotations about the source, and smooth random fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.hashing import standard_normal, uniform
from skylattice.operators.regression import product_sums, weighted_least_squares
from skylattice.operators.spatial import kernel_sum, nearest_on_lattice
from skylattice.operators.variogram import standardised


def source_from_distances(cells: DataFrame, dist: str) -> DataFrame:
    """The point whose distances to the cells best match `dist`, by linear least squares (one row: sx, sy)."""
    x, y = F.col("x"), F.col("y")
    sums = product_sums(cells, [2 * x, 2 * y, F.lit(-1.0)], x * x + y * y - F.col(dist) * F.col(dist), [])
    return weighted_least_squares(sums, 3, []).select(F.col("coef")[0].alias("sx"), F.col("coef")[1].alias("sy"))


def spin_maps(cells: DataFrame, cell_id: str, source: DataFrame, n: int, seed: int, spacing: float) -> DataFrame:
    """(rep, cell, src_cell): each cell mapped to the cell nearest its rotated position, for n angles from 20 to 340
    degrees with a jitter of 5; every second map is mirrored east-west first."""
    k = F.col("rep") - 1
    step = 320.0 / (n - 1) if n > 1 else 0.0
    angle = F.radians(20.0 + step * k + 10.0 * uniform(seed, "rep") - 5.0)
    s = source.withColumn("__k", F.lit(0))
    pts = (cells.select(cell_id, "x", "y").withColumn("__k", F.lit(0)).join(F.broadcast(s), "__k").drop("__k")
           .withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))))
    east = (F.col("x") - F.col("sx")) * F.when(k % 2 == 1, -1.0).otherwise(1.0)
    north = F.col("y") - F.col("sy")
    pts = (pts.withColumn("__a", angle).withColumn("__e", east).withColumn("__n", north)
           .withColumn("rx", F.col("sx") + F.col("__e") * F.cos("__a") - F.col("__n") * F.sin("__a"))
           .withColumn("ry", F.col("sy") + F.col("__e") * F.sin("__a") + F.col("__n") * F.cos("__a")))
    pts = pts.select("rep", cell_id, "rx", "ry")
    return nearest_on_lattice(pts, cells, spacing, "rx", "ry", cell_id).select("rep", cell_id, "src_cell")


def smooth_field(df: DataFrame, value: str, sigma: float, out: str = "field") -> DataFrame:
    """Gaussian-weighted sum over neighbouring locations, standardised over all locations (columns x, y, out)."""
    return standardised(kernel_sum(df, value, sigma, out=out), out)


def noise_labels(rows: DataFrame, cells: DataFrame, cell_id: str, row_id: str, seed: int, smooth: float, out: str = "null_label") -> DataFrame:
    """Labels unrelated to any feature: independent noise (smooth = 0), or one smooth random map plus 10 % noise."""
    if smooth <= 0:
        return rows.withColumn(out, standard_normal(seed, row_id))
    white = cells.select(cell_id, "x", "y").withColumn("__w", standard_normal(seed, cell_id))
    field = smooth_field(white, "__w", smooth, "__f")
    per_cell = white.select(cell_id, "x", "y").hint("merge").join(field, ["x", "y"]).select(cell_id, "__f")
    return (rows.hint("merge").join(per_cell, cell_id, "left")
            .withColumn(out, F.col("__f") + 0.1 * standard_normal(seed, F.lit("row"), F.col(row_id))).drop("__f"))

