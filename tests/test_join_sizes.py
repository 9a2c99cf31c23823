"""Tables that grow with the input never go whole through the driver, however small the planner takes them to be."""

import pytest
from pyspark.sql import functions as F

from skylattice.operators import isotonic, models, quantiles, sampling, statistics, variogram
from skylattice.settings import GridSpec


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture
def cells(spark):
    c = spark.range(400).select(F.col("id").alias("cell_id"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    return c.select("*", (F.col("x") * 3 % 7).alias("a"), (F.col("y") * 5 % 11).alias("b"), (F.col("cell_id") % 5).cast("int").alias("fold"))


def test_rank_correlations_join_without_broadcasts(cells):
    rho = statistics.spearman_pairs(cells, ["a", "b", "x"])
    assert broadcasts(rho) == 0
    want = cells.select("a", "b", "x").toPandas().corr("spearman")
    assert all(abs(r["rho"] - want.loc[r["a"], r["b"]]) < 1e-12 for r in rho.collect())


def test_error_fields_join_without_broadcasts(spark, cells):
    spec = GridSpec(19.0, 73.0, 1.0, 4, 4)
    raster = spark.range(16).select(F.expr("cast(id div 4 as int)").alias("iy"), (F.col("id") % 4).cast("int").alias("ix"), (F.col("id") * 1.0).alias("v"))
    raster = raster.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(3))))
    points = cells.select("cell_id", (19.0 - F.col("y") / 10).alias("lat"), (73.0 + F.col("x") / 10).alias("lon"))
    s = sampling.bilinear_sample(points, raster, spec, "v", ["cell_id"], ["rep"])
    assert broadcasts(s) == 0 and s.count() == 1600
    err = variogram.error_field(s, ["cell_id"], "sampled")
    assert broadcasts(err) == 0
    assert broadcasts(variogram.semivariogram(cells, "a", 5.0)) == 0


def test_copies_are_numbered_without_broadcasts(cells):
    copies = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(9))))
    placed = quantiles.position_within(copies, ["rep", "fold"], F.md5(F.concat_ws(":", "rep", "cell_id")), "cell_id", "p")
    assert broadcasts(placed) == 0
    per_group = placed.groupBy("rep", "fold").agg(F.sort_array(F.collect_list("p")).alias("p")).collect()
    assert all(r["p"] == list(range(80)) for r in per_group)


def test_isotonic_fits_join_without_broadcasts(cells):
    fit = isotonic.decreasing_fit(cells, "a", "x", F.col("fold") != 0, "fit")
    assert "BroadcastHashJoin" not in fit._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_shuffled_tables_join_without_broadcasts(cells):
    assert broadcasts(models.row_shuffles(cells, ["a"], "cell_id", ["fold"], 3, 1)) == 0
    mapping = cells.select(F.lit(1).alias("rep"), "cell_id", F.col("cell_id").alias("src"))
    assert broadcasts(models.remap_group(cells, mapping, ["a"], ["cell_id"], ["src"])) == 0
