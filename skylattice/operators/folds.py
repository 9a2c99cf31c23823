"""Spatial blocks, balanced folds and hold-out splits."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geodesy import block_name
from skylattice.functions.hashing import digest
from skylattice.operators.quantiles import position_within
from skylattice.operators.sizing import join_on
from skylattice.operators.spatial import nearest_point

MAX_SIZE_CLASSES = 100_000


def spatial_blocks(cells: DataFrame, size_km: float, x: str = "x", y: str = "y") -> DataFrame:
    return cells.withColumn("block_id", block_name(x, y, size_km))


def _deal(load: list[int], size: int, count: int) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
    """Deal `count` blocks of one size to the least-loaded fold (first on ties), in closed form.

    Fold f would receive its i-th block of this class at load load[f] + i * size, so the dealing order is the
    merge of k arithmetic sequences. Between the points where another fold joins, each round serves the same
    folds in the same order. Returns the segments (first position, folds per round, offset, order) and new loads.
    """
    base = min(load)
    joins = sorted(range(len(load)), key=lambda f: ((load[f] - base) // size, f))
    segments, offset = [], 0
    for g, f in enumerate(joins, start=1):
        r = (load[f] - base) // size
        offset += r
        served = sorted(joins[:g], key=lambda j: ((load[j] - base) % size, j))
        segments.append((g * r - offset, g, offset, served))
    starts = [s[0] for s in segments]

    def rounds_before(n):  # blocks each fold got among the first n
        _, g, off, order = segments[bisect_right(starts, n) - 1]
        t, rest = divmod(n + off, g)
        got = [0] * len(load)
        for place, j in enumerate(order):
            got[j] = t - (load[j] - base) // size + (1 if place < rest else 0)
        return got

    return segments, [a + b * size for a, b in zip(load, rounds_before(count))]


def balanced_folds(cells: DataFrame, cell: str, block: str, k: int, seed: int) -> DataFrame:
    """(block, n_cells, fold): blocks go, largest first, to the fold with the fewest cells; all cells of a block
    share its fold; ties are ordered by seeded hash.

    The driver sees only the histogram of block sizes (at most one entry per possible size). Each block then finds
    its fold from its position within its size class.
    """
    blocks = cells.select(cell, block).distinct().groupBy(block).agg(F.count("*").alias("n_cells"))
    classes = blocks.groupBy("n_cells").agg(F.count("*").alias("m")).limit(MAX_SIZE_CLASSES + 1).collect()
    if len(classes) > MAX_SIZE_CLASSES:
        raise ValueError("block sizes are not bounded by a block area; choose square blocks of whole cells")
    load, rows = [0] * k, []
    for c in sorted(classes, key=lambda r: -r["n_cells"]):
        segments, load = _deal(load, c["n_cells"], c["m"])
        rows.append((c["n_cells"], segments))
    schema = "n_cells bigint, segs array<struct<start:bigint, g:bigint, off:bigint, folds:array<int>>>"
    plan = cells.sparkSession.createDataFrame(rows, schema)
    placed = position_within(blocks, ["n_cells"], digest(seed, F.col(block)), block, "__j")
    seg = F.element_at(F.filter("segs", lambda s: s["start"] <= F.col("__j")), -1)
    placed = placed.join(F.broadcast(plan), "n_cells").withColumn("__s", seg)
    place = F.pmod(F.col("__j") + F.col("__s.off"), F.col("__s.g")).cast("int")
    return placed.select(block, "n_cells", F.get(F.col("__s.folds"), place).alias("fold"))


def with_folds(cells: DataFrame, cell: str, size_km: float, k: int = 5, seed: int = 42) -> DataFrame:
    blocks = spatial_blocks(cells, size_km)
    return blocks.hint("merge").join(balanced_folds(blocks, cell, "block_id", k, seed).select("block_id", "fold"), "block_id", "left")


def holdout_by_zone(cells: DataFrame, in_test: Column, buffer_km: float, out: str = "split") -> DataFrame:
    """'test' in the zone, 'train' farther than the buffer from every zone cell, 'gap' between."""
    zone = cells.where(in_test).select(F.col("x").alias("zx"), F.col("y").alias("zy")).distinct()
    near = nearest_point(cells, zone, "x", "y", "zx", "zy")
    return near.withColumn(out, F.when(in_test, "test").when(F.coalesce(F.col("nearest_dist") > buffer_km, F.lit(True)), "train")
                           .otherwise("gap")).withColumnRenamed("nearest_dist", f"{out}_dist")


def scheme_roles(df: DataFrame, by: str, values: Sequence, scheme: str) -> DataFrame:
    """Leave-one-out over the values of `by`: every row once per fold with its role."""
    folds = F.array(*[F.lit(v) for v in values])
    return (df.withColumn("scheme", F.lit(scheme)).withColumn("left_out", F.explode(folds))
            .withColumn("role", F.when(F.col(by) == F.col("left_out"), "test").otherwise("train")))


def fold_sizes(df: DataFrame, cell: str, fold: str) -> DataFrame:
    return join_on(df.select(fold, cell).distinct().groupBy(fold).agg(F.count("*").alias("n_cells")),
                   df.groupBy(fold).agg(F.count("*").alias("n_rows")), [fold])
