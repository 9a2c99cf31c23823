import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.functions.geodesy import distance_km
from skylattice.operators import budget, flux, labels, profile_fit, regression, resample, rotate, variogram
from skylattice.operators.raster import pixel_area_m2
from skylattice.settings import GridSpec, WindFrame

SRC = (18.6, 73.83)
SPEC = GridSpec(19.045, 73.355, 0.02, 45, 48)
E_TRUE, TAU = 0.5, 3 * 3600.0


@pytest.fixture(scope="module")
def plume(spark):
    """Observations of a decaying plume under 80 winds, written as a table."""
    rng = np.random.default_rng(0)
    days = 80
    ws, ang = rng.uniform(2.5, 6, days), rng.uniform(0, 2 * np.pi, days)
    lat, lon = SPEC.lat_top - SPEC.res * np.arange(SPEC.n_rows), SPEC.lon_left + SPEC.res * np.arange(SPEC.n_cols)
    lo, la = np.meshgrid(lon, lat)
    dx, dy = (lo - SRC[1]) * 111.320 * np.cos(np.radians(SRC[0])), (la - SRC[0]) * 110.574
    parts = []
    for d in range(days):
        al = (dx * np.cos(ang[d]) + dy * np.sin(ang[d])) * 1000
        ac = (-dx * np.sin(ang[d]) + dy * np.cos(ang[d])) * 1000
        x = np.clip(al, 0, None)
        s = np.sqrt(3000.0**2 + (0.08 * x) ** 2)
        v = np.where(al > 0, E_TRUE / (ws[d] * np.sqrt(2 * np.pi) * s) * np.exp(-x / (ws[d] * TAU)) * np.exp(-0.5 * (ac / s) ** 2), 0)
        v = v + 2e-6 + 1e-7 * rng.normal(size=v.shape)
        v[rng.random(v.shape) < 0.15] = np.nan
        iy, ix = np.indices(v.shape)
        parts.append(pd.DataFrame({"overpass": d, "iy": iy.ravel(), "ix": ix.ravel(), "lat": la.ravel(), "lon": lo.ravel(), "value": v.ravel()}))
    obs = spark.createDataFrame(pd.concat(parts)).withColumn("value", F.when(~F.isnan("value"), F.col("value"))).cache()
    wind = spark.createDataFrame(pd.DataFrame({"overpass": np.arange(days), "u": ws * np.cos(ang), "v": ws * np.sin(ang)}))
    return obs, wind, float(ws.mean())


def test_profile_fit_recovers_rate_and_lifetime(plume):
    obs, wind, w = plume
    frame = WindFrame()
    lines = rotate.line_density(rotate.rotate_bin(obs, wind, SRC, frame), frame=frame).withColumn("k", F.lit(1))
    fit = profile_fit.fit_profiles(lines, ["k"], sloped=True, along_max=45.0).withColumn("mean_wind", F.lit(w))
    r = profile_fit.emissions(fit, ratio=1.0).first()
    assert r["r2"] > 0.95 and not r["outside_bounds"]
    assert r["e_no2_mol_s"] == pytest.approx(E_TRUE, rel=0.2)
    assert r["tau_h"] * 3600 == pytest.approx(TAU, rel=0.25)


def test_divergence_totals_recover_rate(plume):
    obs, wind, _ = plume
    m = flux.emission_map(flux.mean_flux(obs, wind), SPEC, TAU, 2e-6, 1.0)
    m = m.withColumn("lat", SPEC.lat_top - SPEC.res * F.col("iy")).withColumn("lon", SPEC.lon_left + SPEC.res * F.col("ix"))
    d = distance_km("lat", "lon", F.lit(SRC[0]), F.lit(SRC[1]))
    area = pixel_area_m2(SPEC)
    tot = {k: m.where(d <= k).agg(F.sum("emission") * area).first()[0] for k in (15, 25, 35)}
    for v in tot.values():
        assert v == pytest.approx(E_TRUE, rel=0.15)
    assert abs(m.where((d >= 40) & (d < 45)).agg(F.sum("emission") * area).first()[0]) < 0.1 * E_TRUE


def test_multinomial_weights_keep_the_sample_size(spark):
    u = spark.range(37).select(F.col("id").alias("overpass"), (F.col("id") % 2).alias("s"))
    w = resample.multinomial_weights(u, "overpass", 25, 1, ["s"])
    assert {(r["s"], r["n"]) for r in w.groupBy("s", "rep").agg(F.sum("w").alias("n")).collect()} == {(0, 19.0), (1, 18.0)}
    again = resample.multinomial_weights(u.repartition(5), "overpass", 25, 1, ["s"])
    assert w.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        resample.multinomial_weights(u, "overpass", 0, 1)


def test_density_conserves_a_uniform_map(spark):
    spec = GridSpec(19.0, 73.0, 0.01, 40, 40)
    m = spark.range(1600).select(F.expr("cast(id div 40 as int)").alias("iy"), (F.col("id") % 40).cast("int").alias("ix"), F.lit(2e-8).alias("emission"))
    cells = spark.createDataFrame([(1, 18.8, 73.2), (2, 18.7123, 73.3456)], "cell_id int, lat double, lon double")
    d = labels.share_density(m, spark.createDataFrame([(5.0,)], "total double"), spec, cells, "cell_id", 5, (), 0.046)
    for r in d.collect():
        assert r["density"] * 5.0 == pytest.approx(2e-8 * 0.046, rel=1e-12)
    assert labels.TO_T_KM2_YR == 1e6 * 31_557_600 / 1000


def test_label_error_propagation(spark):
    d = spark.createDataFrame([(1, 2.0, 0.5)], "cell_id int, density double, density_sd double")
    s = spark.createDataFrame([("a", 3.0, 2.0, 4.0), ("b", 1.0, 1.0, 1.0)], "season string, e double, e_lo double, e_hi double")
    got = {r["season"]: r for r in labels.assemble(d, s, 10.0, 1.25).collect()}
    k = 10.0 * labels.TO_T_KM2_YR
    assert got["a"]["label"] == pytest.approx(6 * k) and got["a"]["label_annual"] == pytest.approx(6 * k / 1.25)
    assert got["a"]["label_sd"] == pytest.approx(np.hypot(0.5 * 3, 2 * 2 / 3.92) * k) and got["b"]["label_sd"] == pytest.approx(0.5 * k)


def test_weighted_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    w = rng.uniform(0.5, 2, 60)
    y = 1 + x @ [2.0, -1.0, 0.5] + rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "w": w}))
    r = regression.weighted_least_squares(regression.product_sums(df, [F.lit(1.0), F.col("a"), F.col("b"), F.col("c")], F.col("y"), ["g"], F.col("w")), 4, ["g"]).first()
    X = np.column_stack([np.ones(60), x])
    A = X.T @ (w[:, None] * X)
    c = np.linalg.solve(A, X.T @ (w * y))
    chi2 = np.sum(w * (y - X @ c) ** 2) / 56
    np.testing.assert_allclose(r["coef"], c, rtol=1e-9)
    np.testing.assert_allclose(r["se"], np.sqrt(np.diag(np.linalg.inv(A)) * max(chi2, 1)), rtol=1e-9)


def test_collinear_groups_get_null(spark):
    df = spark.createDataFrame([(g, float(i), 2.0 * i if g else float(i * i), float(i)) for g in (0, 1) for i in range(6)], "g int, a double, b double, y double")
    fit = regression.weighted_least_squares(regression.product_sums(df, [F.lit(1.0), F.col("a"), F.col("b")], F.col("y"), ["g"]), 3, ["g"])
    got = {r["g"]: r["coef"] for r in fit.collect()}
    assert got[1] == [None] * 3 and got[0] == pytest.approx([0, 1, 0], abs=1e-9)


def test_draws_match_closed_form(spark):
    e = spark.createDataFrame([(1, 10.0, 10.0), (2, 20.0, 99.0)], "zone int, x double, other double")
    T = budget.Term
    out = {(r["zone"], r["variant"]): r for r in budget.propagate(e, "zone", "x", {"v": [T("a", "lognormal", 0.2)], "w": [T("b", "log_interval", 5.0, 20.0)]}, 4000, 3, "other").collect()}
    s = np.log(1.2)
    assert out[1, "v"]["p50"] == pytest.approx(10, rel=0.02) and out[1, "v"]["p97_5"] == pytest.approx(10 * np.exp(1.96 * s), rel=0.04)
    assert out[1, "w"]["p97_5"] / out[1, "w"]["p2_5"] == pytest.approx(4, rel=0.08)
    assert out[1, "v"]["inside_95"] and not out[2, "v"]["inside_95"]


def test_exponential_variogram_is_recovered(spark):
    h = np.arange(30) + 0.5
    g = 3.0 * (0.2 + 0.8 * (1 - np.exp(-3 * h / 12.0)))
    v = spark.createDataFrame(pd.DataFrame({"lag": np.arange(30), "h": h, "gamma": g}))
    b = variogram.block_size(v, spark.createDataFrame([(3.0,)], "sill0 double")).first()
    assert (b["nugget"], b["sill"], b["range_km"]) == (pytest.approx(0.6, rel=1e-6), pytest.approx(2.4, rel=1e-6), 12.0)
    assert b["first_reach_km"] == h[g >= 2.85][0] and b["block_km"] == np.ceil(max(12.0, b["first_reach_km"]))


def test_replicates_of_a_mean_flux_are_not_shuffled(spark):
    cube = spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 0, 4.0), (2, 0, 1, 1.0)], "overpass int, iy int, ix int, value double")
    wind = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 0.0)], "overpass int, u double, v double")
    w = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 2.0)], "rep int, overpass int, w double")
    f = flux.mean_flux(cube, wind, w, ["rep"])
    assert "hashpartitioning(rep" not in f._jdf.queryExecution().executedPlan().toString()
    assert {(r["rep"], r["ix"]): r["fx"] for r in f.collect()} == {(0, 0): 3.0, (0, 1): 1.0, (1, 0): 4.0, (1, 1): 1.0}


def test_far_emitters_count(spark):
    """An emitter upwind of a sounding counts at any distance."""
    s = spark.createDataFrame([(1, 10.0, 0.0), (2, 2000.0, 5.0), (3, -50.0, 0.0)], "id int, x double, y double").selectExpr("*", "3D AS u", "0D AS v", "95000D AS psurf")
    em = spark.createDataFrame([(0.0, 0.0, 100.0), (0.0, 0.0, 50.0)], "x double, y double, rate double")
    got = {r["id"]: r["pred_ppm"] for r in regression.predicted_enhancement(s, em, ["id"]).collect()}

    def column(x, y):
        sigma = np.sqrt(4 + (0.15 * x) ** 2) * 1000
        return 150 / (3 * np.sqrt(2 * np.pi) * sigma) * np.exp(-0.5 * (y * 1000 / sigma) ** 2)

    assert got[2] > 0 and got[3] == 0
    assert got[2] / got[1] == pytest.approx(column(2000, 5) / column(10, 0), rel=1e-9)
