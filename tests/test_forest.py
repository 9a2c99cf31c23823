"""Forests grown in the tasks: every row predicted once, with and without splits by all tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import forest, models
from skylattice.operators.statistics import skill
from skylattice.plans import CATALOGUE


def planted(spark, n=4000):
    d = spark.range(n).selectExpr("id", "cast(id % 3 as int) AS fold", "(id * 7919 % 1009) / 1009D AS a", "(id * 104729 % 907) / 907D AS b", "cast(id % 7 as double) AS c")
    return d.withColumn("y", F.sin(6 * F.col("a")) + F.col("b") * F.col("c"))


@pytest.mark.parametrize("limit", [1 << 18, 500])
def test_forest_predicts_every_row_once(spark, monkeypatch, limit):
    """No node with more rows than the limit is grown by one task, and the splits above tell the same story."""
    monkeypatch.setattr(forest, "ROWS", limit)
    d = planted(spark)
    o = models.ml_oof(d, ["a", "b", "c"], "y", "fold", [0, 1, 2], "rf", 10, keep=["id"])
    assert o.columns == ["id", "fold", "y", "pred"]
    rows = o.collect()
    assert len(rows) == len({r["id"] for r in rows}) == 4000
    assert skill(o, "y", "pred").first()["r2"] > 0.95


def test_rows_that_train_nothing(spark):
    """Rows without a label are predicted and train nothing; a fold without other rows has no model."""
    d = planted(spark, 600).withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")))
    o = models.ml_oof(d, ["a", "b", "c"], "y", "fold", [0, 1, 2], "rf", 5, keep=["id"])
    assert o.count() == 600 and o.where("pred IS NULL").count() == 0
    alone = models.ml_oof(d.where("fold = 0"), ["a", "b", "c"], "y", "fold", [0], "rf", 5, keep=["id"])
    assert alone.count() == 200 and alone.where("pred IS NOT NULL").count() == 0


def test_large_node_that_no_feature_splits(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 100)
    d = spark.range(900).selectExpr("id", "cast(id % 3 as int) AS fold", "1D AS a", "id % 2 * 1D AS y")
    got = [r["pred"] for r in models.ml_oof(d, ["a"], "y", "fold", [0, 1, 2], "rf", 20, keep=["id"]).collect()]
    assert len(got) == 900 and np.allclose(got, 0.5, atol=0.05)


def test_rows_are_sent_as_often_whatever_the_partitions(spark):
    """The copies of the rows follow the cores; with 211 shuffle partitions each tree had its own."""
    few = forest.together(spark, 1500)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert forest.together(spark, 1500) == few > 1
        d = planted(spark, 300)
        o = models.ml_oof(d, ["a", "b", "c"], "y", "fold", [0, 1, 2], "rf", 100, keep=["id"])
        assert len({r["id"] for r in o.collect()}) == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_half_a_million_vectors_are_held_by_one_task():
    """Two thirds of 720,000 vectors of 64 entries train together; beyond the limit each of 1,500 trees has a copy of them."""
    assert forest.one_task(64) >= 480_000 and forest.one_task(64) * 64 <= forest.BYTES and forest.one_task(5) == forest.ROWS


def test_ablation_grows_whole_forests(spark, monkeypatch, tmp_path):
    """Each of its five feature sets has forests of 500 trees, as `oof_forest` has."""
    rows = [(i, f"Brand#{i % 5}", f"T{i % 3}", i % 50, 900.0 + i) for i in range(1, 400, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    seen = []

    def grown(df, features, label, fold, folds, trees, keep=(), predict=None):
        seen.append((trees, len(folds)))
        return predict.select(*keep, fold, label, F.lit(0.0).alias("pred"))

    monkeypatch.setattr(models, "forest_oof", grown)
    assert CATALOGUE["ablation_forest"].plan(spark, str(tmp_path)).count() == 5
    assert seen == [(500, 5)] * 5


def test_histograms_and_split():
    """Sums by feature, node and bin, counted some features at a time; the split of the least variance."""
    rng = np.random.default_rng(3)
    x, y, w, at = rng.integers(0, forest.BINS, (3000, 6)).astype(np.uint8), rng.normal(size=3000), rng.integers(1, 4, 3000).astype(float), rng.integers(0, 3, 3000)
    y = y / 100 + (x[:, 4] > 9)
    mean = np.array([np.average(y[at == k], weights=w[at == k]) for k in range(3)])
    picks = np.array([[4, 0, 1], [2, 4, 5], [3, 1, 4]])
    n, s = forest._histograms(x, y - mean[at], w, at, picks)
    for k in range(3):
        for j in range(3):
            here = at == k
            assert np.allclose(n[j, k], np.bincount(x[here, picks[k, j]], w[here], forest.BINS))
            assert np.allclose(s[j, k], np.bincount(x[here, picks[k, j]], (w * (y - mean[at]))[here], forest.BINS))
    place, last = forest._best(n, s, 0.0)
    assert [picks[k, place[k]] for k in range(3)] == [4, 4, 4] and all(last == 9)
