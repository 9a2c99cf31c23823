import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.operators import features, folds, models, nulls, statistics
from skylattice.operators.isotonic import decreasing_blocks
from skylattice.operators.models import LeakageError, allowed_features
from skylattice.sources import freeze
from skylattice.streaming import ingest


def test_dealing_equals_one_by_one_greedy():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(2, 7))
        sizes = sorted(rng.choice([225, 210, 90, 40, 7, 1], rng.integers(1, 120)).tolist(), reverse=True)
        load, want = [0] * k, []
        for s in sizes:
            f = int(np.argmin(load))
            want.append(f)
            load[f] += s
        got, cur = [], [0] * k
        for s in sorted(set(sizes), reverse=True):
            segs, new = folds._deal(cur, s, sizes.count(s))
            for j in range(sizes.count(s)):
                seg = [q for q in segs if q[0] <= j][-1]
                got.append(seg[3][(j + seg[2]) % seg[1]])
            cur = new
        assert got == want and cur == load


def test_folds_are_balanced_and_repeatable(spark):
    rng = np.random.default_rng(1)
    c = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(3000), "x": 380 + rng.uniform(0, 60, 3000), "y": 2050 + rng.uniform(0, 60, 3000)}))
    a = folds.with_folds(c, "cell_id", 15)
    n = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(n) == 5 and max(n) - min(n) <= 0.25 * 600
    assert a.groupBy("block_id").agg(F.count_distinct("fold").alias("k")).where("k <> 1").count() == 0
    assert a.select("cell_id", "fold").exceptAll(folds.with_folds(c.repartition(3), "cell_id", 15).select("cell_id", "fold")).count() == 0


def test_direction_mean_points_north(spark):
    f = spark.createDataFrame([(1, "s", 350.0, 1.0), (1, "s", 10.0, 3.0)], "cell_id int, season string, wd850 double, a double")
    r = features.season_means(f, ["a"]).first()
    assert (r["wd850_sin"], r["wd850_cos"], r["a"], r["n_months"]) == (pytest.approx(0, abs=1e-12), pytest.approx(1, abs=1e-12), 2.0, 2)


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "steps and one outlier"])
@pytest.mark.parametrize("chunk", [1 << 16, 4])
def test_isotonic_blocks_against_the_min_max_formula(spark, shape, chunk):
    """Chunks of four points, so that blocks grow over many borders."""
    rng = np.random.default_rng(2)
    n = 60
    y = {"noise": rng.normal(size=n) - np.arange(n) / 20, "rising": np.arange(n) * 1.0, "falling": -np.arange(n) * 1.0, "steps and one outlier": np.append(np.repeat([5.0, 5.0, 1.0], 20)[:-1], 90.0)}[shape]
    w = rng.integers(1, 4, n)
    sw, sy = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(w * y)))
    mean = lambda a, b: (sy[b + 1] - sy[a]) / (sw[b + 1] - sw[a])
    want = [min(max(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    points = spark.createDataFrame([(float(3 * i), int(w[i]), float(y[i])) for i in range(n)], "x double, weight int, y double").repartition(5)
    blocks = sorted((r.x_low, r.x_high, r.y) for r in decreasing_blocks(points, chunk).collect())
    got = [next(v for low, high, v in blocks if low <= 3 * i <= high) for i in range(n)]
    assert np.allclose(got, want) and all(a[2] > b[2] for a, b in zip(blocks, blocks[1:]))


def test_isotonic_of_nothing(spark):
    d = spark.createDataFrame([(1.0, 2.0, False), (None, 3.0, True), (2.0, None, True)], "dist double, y double, train boolean")
    assert {r.residual for r in models.isotonic_detrend(d, "y", "dist", F.col("train")).collect()} == {None}


def test_isotonic_pools_violators_and_clips(spark):
    d = spark.createDataFrame([(1.0, 10.0, True), (2.0, 6.0, True), (3.0, 8.0, True), (3.0, 6.0, True), (4.0, 1.0, True), (9.0, 0.0, False)], "dist double, y double, train boolean")
    r = {x["dist"]: x["y"] - x["residual"] for x in models.isotonic_detrend(d, "y", "dist", F.col("train")).collect()}
    assert r[1.0] == 10 and r[2.0] == pytest.approx(20 / 3) and r[3.0] == pytest.approx(20 / 3) and r[4.0] == 1 and r[9.0] == 1


def test_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1]
    y = x @ [1.0, 0.2, 3.0] + rng.normal(size=200)
    f = np.arange(200) % 4
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "fold": f}))
    got = models.ridge_oof(df, ["a", "b", "c"], "y", "fold", alphas=[3.0]).orderBy("id").toPandas()
    want = np.empty(200)
    for k in range(4):
        tr = f != k
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - m) / s
        b = np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        want[f == k] = y[tr].mean() + ((x[f == k] - m) / s) @ b
    np.testing.assert_allclose(got.pred, want, rtol=1e-8)
    tuned = models.ridge_oof(df, ["a", "b", "c"], "y", "fold")
    assert statistics.skill(tuned, "y", "pred").first()["r2"] > 0.3


def test_spearman_over_common_rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 20, (300, 3)).astype(float), columns=list("abc"))
    pdf["b"] += pdf["a"]
    assert_pairs(statistics.spearman_pairs(spark.createDataFrame(pdf), list("abc"), complete=True), pdf)
    pdf = pdf.mask(rng.random(pdf.shape) < 0.3)
    holes = spark.createDataFrame([tuple(None if np.isnan(x) else x for x in r) for r in pdf.to_numpy().tolist()], "a double, b double, c double")
    assert_pairs(statistics.spearman_pairs(holes, list("abc")), pdf)
    with pytest.raises(Exception, match="is not complete"):
        statistics.spearman_pairs(holes, list("abc"), complete=True).collect()


def assert_pairs(got, pdf):
    want = pdf.rank().corr() if not pdf.isna().any().any() else pd.DataFrame({a: {b: pdf[[a, b]].dropna().rank().corr().iloc[0, 1] for b in pdf if b != a} for a in pdf})
    rows = got.collect()
    assert len(rows) == 3
    for r in rows:
        assert r["rho"] == pytest.approx(want.loc[r["b"], r["a"]], abs=1e-12)


def test_row_shuffles_touch_training_rows_only(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"cell": np.arange(400), "fold": np.arange(400) % 4, "x": x, "y": 3 * x + 0.1 * rng.normal(size=400)}))
    null = df.drop("x").join(df.select(F.expr("399 - cell").alias("cell"), "x"), "cell").withColumn("rep", F.lit(1)).select("rep", *df.columns)
    got = {r["rep"]: r["score"] for r in models.permutation_scores(df, null, ["x"], "y", "fold", "cell", "r2", train_only=True).collect()}
    x2, y = x[::-1], np.array([r["y"] for r in df.orderBy("cell").collect()])
    pred = np.empty(400)
    for k in range(4):
        tr = np.arange(400) % 4 != k
        z = (x2[tr] - x2[tr].mean()) / x2[tr].std()
        b = z @ (y[tr] - y[tr].mean()) / (z @ z + 1) / x2[tr].std()
        pred[~tr] = y[tr].mean() + b * (x[~tr] - x2[tr].mean())
    assert got[0] > 0.99 and got[1] == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_every_row_shuffle_is_another_one(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("fold"), F.col("id").alias("v"))
    r = models.row_shuffles(df, ["v"], "id", ["fold"], 5, 42)
    assert r.where("v % 2 <> fold").count() == 0
    assert r.groupBy("rep").agg(F.expr("md5(to_json(sort_array(collect_list(struct(id, v)))))").alias("d")).select("d").distinct().count() == 5


def model_rows(spark, n=160, effect=3.0):
    rng = np.random.default_rng(4)
    x, g, h = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = x + effect * g + 0.3 * rng.normal(size=n)
    return spark.createDataFrame([(i, i % 2, float(i % 23), float(x[i]), float(g[i]), float(h[i]), None if i == 7 else float(y[i])) for i in range(n)],
                                 "id int, fold int, dist double, x double, g double, h double, y double")


def test_shuffled_sums_equal_those_of_shuffled_tables(spark):
    df = model_rows(spark).where("y IS NOT NULL").withColumn("k", F.col("id") % 3)
    got = {(r["k"], r["rep"], r["fold"]): r["xx"] for r in models.shuffled_sums(df, ["x", "dist"], ["g", "h"], "y", "fold", "id", 3, 42, ["k"]).collect()}
    tables = models.row_shuffles(df, ["g", "h"], "id", ["k", "fold"], 3, 42)
    want = {(r["k"], r["rep"], r["fold"]): r["xx"] for r in models.fold_sums(tables, ["x", "dist", "g", "h"], "y", "fold", ["k", "rep"]).collect()}
    assert set(got) == set(want) and len(got) == 18 and all(np.allclose(got[k], want[k]) for k in got)


def test_folds_held_by_tasks_give_the_sums_of_rows_in_copies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, None if i == 3 else i // 2 if i < 12 else i, None if i % 7 == 0 else i % 3, float(rng.normal()), None if i % 11 == 5 else float(rng.normal()),
             None if i % 13 == 4 and k else float(rng.normal())) for k in (1, 2) for i in range(120)]
    rows += rows[40:60]
    df = spark.createDataFrame(rows, "k int, id long, fold int, x double, g double, y double").repartition(3)
    df = df.withColumn("g", F.when(F.col("id") >= 6, F.col("g")).otherwise(1.0)).withColumn("x", F.when(F.col("id") >= 6, F.col("x")).otherwise(2.0))
    df = df.withColumn("y", F.when(F.col("id") >= 6, F.col("y")).otherwise(0.5))  # rows of one id are alike: the order among them is free

    def sums():
        return {(r["k"], r["rep"], r["fold"]): r["xx"] for r in models.shuffled_sums(df, ["x"], ["g"], "y", "fold", "id", 9, 5, ["k"]).collect()}

    held = sums()
    monkeypatch.setattr(models, "HELD", 0)
    copied = sums()
    assert held.keys() == copied.keys() and len(held) == 2 * 9 * 4
    for key, want in copied.items():
        np.testing.assert_allclose(held[key], want, rtol=1e-9, atol=1e-9)


def test_no_replicate_copies_rows_or_shuffles_predictions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(90), "cell": np.arange(90) // 3, "fold": np.arange(90) % 3, "x": rng.normal(size=90), "g": rng.normal(size=90)})
    pdf["y"] = pdf.x + pdf.g + rng.normal(size=90)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("id") % 10 != 4, F.col("y"))).withColumn("x", F.when(F.col("id") % 17 != 3, F.col("x")))
    coef = models.ridge_coefficients(models.fold_sums(df.where("x IS NOT NULL"), ["x", "g"], "y", "fold").crossJoin(spark.createDataFrame([(0,), (1,)], "rep int")), 4, "fold", ["rep"], [1.0])
    scores = ["r2", "rmse", "mae", "spatial_r2", "temporal_r2", "n_rows"]
    want = statistics.skill_split(models.ridge_predictions(df, coef, ["x", "g"], "fold", ["rep"]), "cell", "y", "pred", ["rep"]).orderBy("rep").select(scores).toPandas()
    monkeypatch.setattr(models, "ERRORS", 8)  # four rows at once: cells go on over their borders
    got = models.replicate_skill(df, coef, ["x", "g"], "y", "fold", "cell", []).orderBy("rep").select(scores).toPandas()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9)

    def copies(*args, **kwargs):
        raise AssertionError("a row was copied for every replicate")

    monkeypatch.setattr(models, "position_within", copies)
    monkeypatch.setattr(models, "ridge_predictions", copies)
    assert models.row_permutation_scores(df.where("x IS NOT NULL"), ["x"], ["g"], "y", "fold", "cell", 6, 1).count() == 7


def test_row_permutation_scores_equal_those_of_shuffled_tables(spark):
    df = model_rows(spark)
    got = {r["rep"]: r["score"] for r in models.row_permutation_scores(df, ["x"], ["g"], "y", "fold", "id", 4, 1, "r2").collect()}
    known = df.where("y IS NOT NULL")
    null = models.row_shuffles(known, ["g"], "id", ["fold"], 4, 1).select("rep", *df.columns)
    want = {r["rep"]: r["score"] for r in models.permutation_scores(known, null, ["x", "g"], "y", "fold", "id", "r2", models.PENALTIES, train_only=True).collect()}
    assert set(got) == set(range(5)) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_permutation_on_isotonic_residuals(spark):
    """The residual of every fold comes from the rows outside it; a planted effect is found, an empty one is not."""
    df = model_rows(spark).where("y IS NOT NULL")
    targets = {(r["held"], r["id"]): r["__residual"] for r in models.residual_targets(df, "y", "dist", "fold", [0, 1]).collect()}
    for f in (0, 1):
        alone = models.isotonic_detrend(df, "y", "dist", F.col("fold") != f)
        assert all(targets[f, r["id"]] == pytest.approx(r["residual"]) for r in alone.collect())
    p = {g: models.permutation_test(models.row_permutation_scores(df, ["x"], [g], "y", "fold", "id", 99, 3, dist="dist", folds=[0, 1])).first() for g in ("g", "h")}
    assert p["g"]["p_value"] == pytest.approx(0.01) and p["g"]["significant"] and p["g"]["n_perm"] == 99
    assert p["h"]["p_value"] > 0.05 and abs(p["h"]["effect"]) < 0.05


def test_forest_permutation_of_a_planted_and_an_empty_effect(spark):
    df = model_rows(spark).where("y IS NOT NULL")
    p = {g: models.permutation_test(models.forest_permutation_scores(df, ["x"], [g], "y", "fold", [0, 1], "id", 4, 3, trees=5, score="r2"), level=0.2).first() for g in ("g", "h")}
    assert p["g"]["p_value"] == pytest.approx(0.2) and p["g"]["effect"] > 0.5
    assert abs(p["h"]["effect"]) < 0.3


def test_permutation_p_counts_ties(spark):
    s = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.1), (3, 0.7), (4, 0.2), (5, 0.0)], "rep int, score double")
    r = models.permutation_test(s).first()
    assert r["p_value"] == pytest.approx(3 / 6) and r["effect"] == pytest.approx(0.5 - 0.3) and not r["significant"]


def test_spin_maps_and_source(spark):
    c = spark.range(900).select(F.col("id").alias("cell"), (F.col("id") % 30 + 0.5).alias("x"), (F.expr("id div 30") + 0.5).alias("y"))
    c = c.withColumn("d", F.hypot(F.col("x") - 15.3, F.col("y") - 14.8))
    src = nulls.source_from_distances(c, "d")
    assert tuple(src.first()) == (pytest.approx(15.3, abs=1e-6), pytest.approx(14.8, abs=1e-6))
    m = nulls.spin_maps(c, "cell", src, 3, 1, 1.0)
    assert m.count() == 2700 and m.where("src_cell IS NULL").count() == 0


def test_leakage_guard():
    assert allowed_features(["hcho", "viirs_rad"], "label_fd") == ["hcho", "viirs_rad"]
    for bad in (["no2"], ["ref_inventory_co2"]):
        with pytest.raises(LeakageError):
            allowed_features(bad, "label_fd")
    assert allowed_features(["no2"], "label_fd", waive=["no2"]) == ["no2"]


def test_duplicate_layer_keys_are_refused(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    layer = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(Exception, match="several rows for one key"):
        features.assemble(base, [(layer, ["k"])]).collect()
    with pytest.raises(Exception, match="missing features"):
        features.complete(features.assemble(base, [(layer.limit(1), ["k"])]), ["v"]).collect()


def test_fingerprint_gate(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    t = freeze.write_frozen(df, str(tmp_path / "t"))
    fp = freeze.fingerprint(t).first()
    assert freeze.fingerprint(df.repartition(7).orderBy(F.desc("id"))).first() == fp
    assert freeze.fingerprint(df.union(df.limit(1))).first() != fp
    assert freeze.open_frozen(spark, str(tmp_path / "t"), fp["digest_sum"], fp["digest_xor"]).count() == 100
    with pytest.raises(freeze.FingerprintMismatch):
        freeze.open_frozen(spark, str(tmp_path / "t"), "0", "0")


def test_ingest_keeps_late_rows_and_drops_repeated_ones(spark, tmp_path):
    schema = "id int, ts timestamp_ntz, v int"
    deliveries = [[(1, "2024-03-01", 1), (2, "2024-03-02", 2), (None, "2024-03-02", 9)],
                  [(2, "2024-03-02", 2), (3, "2023-01-05", 3), (None, "2024-03-02", 9), (4, "2024-03-02", 4), (4, "2024-03-02", 4)],
                  [(3, "2023-01-05", 3), (5, None, 5)], [(5, None, 5)]]
    for i, rows in enumerate(deliveries):
        spark.createDataFrame([(str(a) if a else None, b, c) for a, b, c in rows], "id string, ts string, v int").selectExpr("int(id) AS id", "to_timestamp_ntz(ts) AS ts", "v").write.parquet(f"{tmp_path}/in/{i}")
        s = ingest.watch_files(spark, f"{tmp_path}/in/*", schema).withColumn("day", F.to_date("ts"))
        ingest.ingest(s, f"{tmp_path}/out", f"{tmp_path}/check", "day", key="id").awaitTermination()
    got = sorted((r["v"], str(r["day"])) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the row a year late is there; rows without an id are all there
    assert got == [(1, "2024-03-01"), (2, "2024-03-02"), (3, "2023-01-05"), (4, "2024-03-02"), (5, "None"), (9, "2024-03-02"), (9, "2024-03-02")]


def test_append_log_retry_is_harmless(spark, tmp_path):
    rows = spark.createDataFrame([("g1", 1), ("g1", 2)], "granule string, v int")
    keys = spark.createDataFrame([("g1",), ("g2",)], "granule string")  # g2 was scanned and held nothing
    for _ in range(2):
        ingest.append_log(rows, str(tmp_path / "log"), str(tmp_path / "done"), ["granule"], keys, "granule")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    cand = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "granule string")
    assert [r["granule"] for r in ingest.pending(cand, spark.read.parquet(str(tmp_path / "done")), ["granule"]).collect()] == ["g3"]


def test_score_table_with_tuned_penalties_equals_separate_fits(spark):
    rng = np.random.default_rng(3)
    n = 240
    t = pd.DataFrame({"cell": np.arange(n) % 60, "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n), "block": np.arange(n) % 12})
    t["fold"], t["zone"] = t.block % 4, np.select([t.block < 3, t.block > 4], [0.0, -1.0], np.nan)
    t["y"] = 2 * t.a - t.b + rng.normal(size=n)
    t.loc[::17, "y"] = np.nan
    clean = t.astype(object).where(t.notna(), None)
    df = spark.createDataFrame(clean.to_dict("records"), "cell long, a double, b double, c double, block long, fold long, zone double, y double")
    # names that the result uses, and a row without a feature
    df = df.withColumns({"target": F.lit("other"), "scheme": F.lit(1), "features": F.lit(2), "x0": F.lit("z"), "domain": F.lit(3), "part": F.lit(4)})
    df = df.unionByName(df.limit(1).withColumns({"a": F.lit(None).cast("double"), "y": F.lit(1e6)}))
    sets, grid = {"small": ["a"], "large": ["c", "a", "b"]}, [0.01, 10.0, 300.0]
    ceilings = spark.createDataFrame([("y", "all", 0.5), ("y", "upper", 0.0)], "target string, domain string, ceiling double")
    got = models.score_table(df, sets, {"blocks": F.col("fold"), "zone": F.col("zone")}, {"y": F.col("y")}, {"all": F.lit(True), "upper": F.col("cell") >= 30},
                             "cell", F.col("block") % 3, ceilings, grid).toPandas().set_index(["scheme", "features", "domain"])
    assert len(got) == 8

    def fit(rows, cols, alpha):
        x = rows[cols].to_numpy()
        m, s = x.mean(0), x.std(0)
        z = (x - m) / s
        b = np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ (rows.y - rows.y.mean()).to_numpy())
        return lambda r: rows.y.mean() + ((r[cols].to_numpy() - m) / s) @ b

    known = t[t.y.notna()]
    for scheme, column in (("blocks", "fold"), ("zone", "zone")):
        rows = known[known[column].notna()]
        for name, cols in sets.items():
            parts = []
            for f in sorted(x for x in rows[column].unique() if x >= 0):
                train, test = rows[rows[column] != f], rows[rows[column] == f]

                def error(alpha):
                    groups = [(train[train.block % 3 != g], train[train.block % 3 == g]) for g in range(3)]
                    return sum(((fit(rest, cols, alpha)(held) - held.y) ** 2).sum() for rest, held in groups if len(held))

                parts.append(test.assign(p=fit(train, cols, min(grid, key=error))(test)))
            scored = pd.concat(parts)
            for domain, part in (("all", scored), ("upper", scored[scored.cell >= 30])):
                want = 1 - ((part.y - part.p) ** 2).sum() / ((part.y - part.y.mean()) ** 2).sum()
                row = got.loc[(scheme, name, domain)]
                assert row.n_rows == len(part) and abs(row.r2 - want) < 1e-9
                assert abs(row.ceiling_normalised_r2 - want / 0.5) < 1e-9 if domain == "all" else pd.isna(row.ceiling_normalised_r2)
