import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.operators import covering, qc, raster, sampling, spatial
from skylattice.settings import GridSpec

SPEC = GridSpec(10.0, 0.0, 1.0, 5, 6)


def grid(spark, a):
    rows = [(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "iy int, ix int, z double")


def back(df, shape, col="z"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[col] is not None:
            out[r["iy"], r["ix"]] = r[col]
    return out


def neighbours(a, h):
    p = np.pad(a, h, mode="symmetric")
    return np.stack([p[i:i + a.shape[0], j:j + a.shape[1]] for i in range(2 * h + 1) for j in range(2 * h + 1)])


@pytest.mark.parametrize("size", [3, 5, 7])
def test_box_filters_mirror_the_edge(spark, size):
    a = np.random.default_rng(size).normal(size=(5, 6))
    n = neighbours(a, size // 2)
    np.testing.assert_allclose(back(raster.box_mean(grid(spark, a), SPEC, size, "z"), a.shape), n.mean(0), rtol=1e-12)
    np.testing.assert_allclose(back(raster.box_max(grid(spark, a), SPEC, size, "z"), a.shape), n.max(0))
    np.testing.assert_allclose(back(raster.box_median(grid(spark, a), SPEC, size, "z"), a.shape), np.median(n, axis=0))


def test_gradient_edges_and_gaps(spark):
    a = np.random.default_rng(1).normal(size=(5, 6))
    a[2, 3] = np.nan
    d = grid(spark, a).withColumn("gx", raster.gradient(None, "z", "ix", 6, 2.0)).withColumn("gy", raster.gradient(None, "z", "iy", 5, -3.0))
    gx, gy = np.gradient(a, np.arange(6) * 2.0, axis=1), np.gradient(a, -3.0 * np.arange(5), axis=0)
    gx[2, 3] = gy[2, 3] = np.nan
    np.testing.assert_allclose(back(d, a.shape, "gx"), gx)
    np.testing.assert_allclose(back(d, a.shape, "gy"), gy)


def test_bilinear(spark):
    a = np.arange(30, dtype=float).reshape(5, 6)
    a[4, 5] = np.nan
    pts = spark.createDataFrame([(1, 10.0, 0.0), (2, 9.5, 0.5), (3, 6.0, 2.25), (4, 10.1, 1.0), (5, 6.5, 4.5), (6, 6.0, 4.0)], "p int, lat double, lon double")
    got = {r["p"]: r["sampled"] for r in sampling.bilinear_sample(pts, grid(spark, a), SPEC, "z", ["p"]).collect()}
    assert got == {1: 0.0, 2: 3.5, 3: 26.25, 4: None, 5: None, 6: 28.0}


def test_line_lengths_in_cells(spark):
    s = spark.createDataFrame([("m", 0.5, 0.5, 2.5, 0.5), ("m", 0.0, 0.0, 2.0, 2.0), ("n", 1.0, 0.25, 1.0, 0.75), ("n", 5.0, 5.0, 5.0, 5.0)],
                              "klass string, x1 double, y1 double, x2 double, y2 double")
    cells = spatial.cell_lattice(spark, 0, 3, 0, 3, 1.0).withColumn("cell_id", F.concat_ws("_", "cx", "cy"))
    got = {r["cell_id"]: (r["m_km"], r["n_km"]) for r in spatial.line_km_per_cell(s, cells, 1.0, ["m", "n"]).collect()}
    assert len(got) == 9
    assert got["0_0"] == (pytest.approx(0.5 + 2**0.5), pytest.approx(0.5))  # an edge counts in both cells
    assert got["1_0"] == (pytest.approx(1.0), pytest.approx(0.5))
    assert got["1_1"][0] == pytest.approx(2**0.5) and got["2_0"][0] == pytest.approx(0.5) and got["2_2"] == (0.0, 0.0)


def test_cover_counts_overlaps_once(spark):
    sq = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    polys = spark.createDataFrame([([sq(0.0, 0.0, 1.0, 0.6)],), ([sq(0.0, 0.2, 1.0, 1.0)],), ([sq(1.0, 0.0, 1.4, 1.0)],)], "rings array<array<struct<x: double, y: double>>>")
    cells = spatial.cell_lattice(spark, 0, 3, 0, 1, 1.0).withColumn("cell_id", F.col("cx"))
    got = {r["cell_id"]: r["cover"] for r in covering.covered_share(polys, "rings", cells, 1.0, 10).collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(0.4), 2: 0.0}


RINGS = "array<array<struct<x: double, y: double>>>"


def ray_parity(px, py, rings):
    """Even-odd rule by rays, written apart from the library."""
    odd = np.zeros(len(px), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            up = (y1 > py) != (y2 > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= up & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return odd


@pytest.mark.parametrize("whole", [False, True])
def test_points_in_areas_with_holes_parts_and_one_hot_cell(spark, whole):
    """Star-shaped rings with holes and parts, wide enough for all block sizes; whole coordinates put vertices on cell borders."""
    rng = np.random.default_rng(11)
    areas = []
    for k in range(6):
        rings = []
        for part in range(1 + k % 3):
            a = np.sort(rng.uniform(0, 2 * np.pi, 5 + 7 * k))
            for r in (1.0, 0.4):  # outline and hole
                xy = np.stack([np.cos(a), np.sin(a)], 1) * (rng.uniform(0.6, 1.0, len(a)) * [6, 20, 90][k % 3] * r)[:, None] + [200 * part - 40, 7.5 * k - 20]
                rings.append([tuple(map(float, v)) for v in (np.round(xy) if whole else xy)])
        areas.append((k, rings))
    areas += [areas[1], (90, []), (91, [[(0.0, 0.0), (1.0, 1.0)]]), (92, None)]  # repeated row, no ring, no area, null
    p = np.vstack([rng.uniform(-150, 450, (3000, 2)), rng.uniform(0, 1, (3000, 2)) - [40, 20]])
    p = np.round(p * 2) / 2 if whole else p
    pts = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}))
    pts = pts.unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0)], "i bigint, x double, y double"))
    got = covering.points_in_areas(pts, spark.createDataFrame(areas, f"k int, rings {RINGS}"), "rings", 1.0, ["i"], ["k"])
    want = sorted((int(i), k) for k, rings in areas for i in np.flatnonzero(ray_parity(p[:, 0], p[:, 1], rings or [])))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 3000
    assert covering.points_in_areas(pts.limit(0), spark.createDataFrame(areas, f"k int, rings {RINGS}"), "rings", 1.0, ["i"], ["k"]).count() == 0


def test_covered_share_equals_brute_force_and_interior_grows_with_the_outline(spark):
    big = [[(0.3, 0.2), (150.7, 4.1), (120.2, 90.9), (3.3, 77.7)], [(50.0, 30.0), (60.0, 30.0), (60.0, 41.5), (50.0, 41.5)]]
    small = [[(140.0, -3.0), (152.5, -3.0), (152.5, 9.0)]]
    areas = spark.createDataFrame([(big,), (small,), (small,)], f"rings {RINGS}")
    cells = spatial.cell_lattice(spark, -2, 156, -5, 94, 1.0).withColumn("cell_id", F.concat_ws("_", "cx", "cy"))
    got = covering.covered_share(areas, "rings", cells, 1.0, 9).toPandas()
    cx, cy = (got.cell_id.str.split("_").str[i].astype(int).to_numpy() for i in (0, 1))
    want = np.zeros(len(got))
    for k in range(81):
        px, py = cx + (k % 9 + 0.5) / 9, cy + (k // 9 + 0.5) / 9
        want += ray_parity(px, py, big) | ray_parity(px, py, small)
    np.testing.assert_allclose(got.cover, want / 81, atol=1e-12)
    pieces = covering.covering(areas, "rings", 1.0).groupBy("full").count().toPandas().set_index("full")["count"]
    assert pieces[True] < 0.3 * (got.cover == 1).sum()


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_tree_equals_brute_force(spark, clustered):
    rng = np.random.default_rng(7)
    p = rng.normal(0, 0.01, (400, 2)) if clustered else rng.uniform(-20, 60, (400, 2))
    p = np.vstack([p, [[55.0, -3.0]], p[:1]])
    q = rng.uniform(-200, 200, (150, 2))
    pts = spark.createDataFrame(pd.DataFrame({"px": p[:, 0], "py": p[:, 1], "i": np.arange(len(p))}))
    qs = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "x": q[:, 0], "y": q[:, 1]}))
    got = spatial.nearest_point(qs, pts, "x", "y", "px", "py", ["i"], order="i").orderBy("id").toPandas()
    d = np.hypot(q[:, None, 0] - p[None, :, 0], q[:, None, 1] - p[None, :, 1])
    np.testing.assert_allclose(got.nearest_dist, d.min(1), rtol=1e-9)
    assert got.i.tolist() == d.argmin(1).tolist()


def test_nearest_of_few_and_of_crowded_points(spark):
    rng = np.random.default_rng(11)
    q = np.vstack([rng.uniform(-5, 5, (200, 2)), rng.normal(0, 1e-7, (50, 2)), [[0.0, 0.0], [2.0, 0.5]]])
    qs = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(q)), "x": q[:, 0], "y": q[:, 1]}))
    few = np.array([[1.0, 0.0], [3.0, 1.0], [1.0, 0.0], [-4.0, 2.0]])  # a repeated place, and ties between places
    crowded = np.vstack([rng.normal(0, 1e-7, (3000, 2)), rng.uniform(-5, 5, (20, 2)), np.zeros((500, 2))])
    for p in (few, crowded):
        pts = spark.createDataFrame(pd.DataFrame({"px": p[:, 0], "py": p[:, 1], "i": np.arange(len(p))}))
        got = spatial.nearest_point(qs, pts, "x", "y", "px", "py", ["i"], order="i").orderBy("id").toPandas()
        d = (q[:, None, 0] - p[None, :, 0]) ** 2 + (q[:, None, 1] - p[None, :, 1]) ** 2
        np.testing.assert_allclose(got.nearest_dist, np.sqrt(d.min(1)), rtol=1e-9)
        assert got.i.tolist() == d.argmin(1).tolist()
    none = spatial.nearest_point(qs, pts.limit(0), "x", "y", "px", "py", ["i"], order="i")
    assert none.where("nearest_dist IS NULL AND i IS NULL").count() == len(q) and none.columns == ["id", "x", "y", "nearest_dist", "i"]


def test_lag_sums_with_repeated_locations(spark):
    rng = np.random.default_rng(2)
    x, y, z = rng.integers(0, 6, 120).astype(float), rng.integers(0, 6, 120).astype(float), rng.normal(size=120)
    got = spatial.lag_sums(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z})), "z", 4.0, 1.0).orderBy("lag").toPandas()
    i, j = np.triu_indices(120, 1)
    d = np.hypot(x[i] - x[j], y[i] - y[j])
    keep = d < 4
    lag = np.floor(d[keep]).astype(int)
    want = np.bincount(lag, 0.5 * (z[i] - z[j])[keep] ** 2)
    np.testing.assert_allclose(got.half_sq, want, rtol=1e-9)
    assert got.n_pairs.tolist() == np.bincount(lag).tolist()


def cube(spark, seed=0, days=60, spikes=0.005):
    rng = np.random.default_rng(seed)
    v = 5e-5 + 5e-6 * rng.normal(size=(days, 5, 6))
    hit = rng.random(v.shape) < spikes * 4
    v[hit] += rng.choice([-1, 1], hit.sum()) * rng.uniform(4e-5, 6e-5, hit.sum())
    t, i, j = np.indices(v.shape)
    pdf = pd.DataFrame({"overpass": t.ravel().astype(int), "iy": i.ravel().astype(int), "ix": j.ravel().astype(int), "value": v.ravel(), "spike": hit.ravel()})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["temporal", "domain"])
def test_fences_catch_spikes(spark, method):
    f = qc.iqr_filter(cube(spark), method, k=3.0)
    n, caught, false = f.agg(F.count_if("spike"), F.count_if(F.expr("spike AND is_outlier")), F.count_if(F.expr("NOT spike AND is_outlier"))).first()
    assert caught >= 0.8 * n and false <= 0.005 * 1800
    assert f.count() == 1800 and f.where("is_outlier AND value IS NOT NULL").count() == 0


def test_fences_keep_constant_series_and_boundaries(spark):
    df = spark.createDataFrame([(t, 0, 0, 1.0) for t in range(9)] + [(9, 0, 0, None)] + [(t, 0, 1, float(x)) for t, x in enumerate([0, 0, 2, 2, 8, 2, 0, 0])],
                               "overpass int, iy int, ix int, value double")
    f = qc.iqr_filter(df, "temporal", k=3.0)
    assert [r["value"] for r in f.where("is_outlier").collect()] == []  # q3 + 3 * iqr = 8 stays
    assert qc.removed_fraction(f).first()["removed_fraction"] == 0.0


def test_nearest_point_ignores_missing_coordinates(spark):
    from skylattice.operators import spatial

    nan = float("nan")
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 0.0), ("c", None, 1.0), ("d", nan, 1.0)], "name string, px double, py double")
    rows = spark.createDataFrame([(1, 1.0, 0.0), (2, 9.0, 0.0), (3, None, 0.0), (4, nan, 0.0)], "id long, x double, y double")
    got = {r["id"]: (r["name"], r["nearest_dist"]) for r in spatial.nearest_point(rows, points, px="px", py="py", cols=["name"], order="name").collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 1.0), 3: (None, None), 4: (None, None)}


def test_row_digest_separates_rows(spark):
    from pyspark.sql import functions as F

    from skylattice.sources.freeze import row_digest

    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("a\\", "b"), ("a", "\\b")], "p string, q string")
    assert rows.select(row_digest([F.col("p"), F.col("q")]).alias("d")).distinct().count() == 6


def test_kernel_neighbours_meet_before_they_are_spread(spark):
    """A stretch of a row is brought together before each of its points becomes many, along x and along y."""
    d = spark.range(300).selectExpr("id % 20 + 0.5D AS x", "id div 20 + 0.5D AS y", "1D AS v")
    plan = spatial.kernel_sum(d, "v", 2.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2


@pytest.mark.parametrize("spacing", [1.0, 0.25])
def test_kernel_sums_equal_all_pairs(spark, spacing):
    """Holes, repeated locations, an origin off zero, and weights far beyond four sigma."""
    rng = np.random.default_rng(8)
    x, y = (7.3 + spacing * rng.integers(0, 25, 200) for _ in range(2))
    w = np.append(rng.normal(size=199), 1e7)
    got = spatial.kernel_sum(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "v": w, "k": np.arange(200) % 2})).repartition(4), "v", 2.0 * spacing, ["k"], spacing=spacing).collect()
    assert len(got) == len(set(zip(np.arange(200) % 2, x, y)))
    for r in got:
        own = np.arange(200) % 2 == r["k"]
        want = (w * np.exp(-((x - r["x"]) ** 2 + (y - r["y"]) ** 2) / (2 * (2 * spacing) ** 2)))[own].sum()
        assert r["field"] == pytest.approx(want, rel=1e-9, abs=1e-8)
    with pytest.raises(Exception, match="off the lattice"):
        spatial.kernel_sum(spark.createDataFrame([(0.0, 0.0, 1.0), (0.4, 1.0, 1.0)], "x double, y double, v double"), "v", 1.0).collect()


def test_region_totals_take_cells_from_the_rows_and_lose_none(spark):
    from skylattice.operators.inventory import region_totals

    rows = [("a", 18.65, 73.25, 2.0), ("a", 18.650000000000002, 73.25, 3.0), ("a", -5.05, 300.15, 7.0), ("b", 18.61, 73.29, 1.0), ("b", None, None, None)]
    inv = spark.createDataFrame(rows, "species string, lat double, lon double, value double")
    got = {r["species"]: r["total"] for r in region_totals(inv, 0.1, lambda lat, lon: (lon < 73.25) | (lat < 0), ["species"]).collect()}
    assert got == {"a": pytest.approx(2.5 + 7.0), "b": pytest.approx(0.5)}  # half of the cell lies west of 73.25
    lost = inv.unionByName(spark.createDataFrame([("c", 1.0, None, 4.0)], inv.schema))
    with pytest.raises(Exception, match="no place"):
        region_totals(lost, 0.1, lambda lat, lon: lat < 0, ["species"]).collect()


def test_zones_named_by_a_column(spark):
    df = spark.createDataFrame([("p", 1.0), ("q", 2.0), (None, 4.0)], "zone_name string, v double")
    got = spatial.zone_totals(df, {"all": F.lit(True)}, F.col("v"), names=[F.col("zone_name")]).collect()
    assert {r["zone"]: r["total"] for r in got} == {"all": 7.0, "p": 1.0, "q": 2.0}


def test_bilinear_neither_explodes_nor_aggregates_the_points(spark):
    pts = spark.createDataFrame([(1, 9.5, 0.5)], "p int, lat double, lon double")
    s = sampling.bilinear_sample(pts, grid(spark, np.arange(30, dtype=float).reshape(5, 6)), SPEC, "z", ["p"])
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_polygon_touching_a_corner_of_the_box_meets_it(spark):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    touching = F.array(p(23.0, 19.0), p(21.0, 21.0), p(19.0, 19.0), p(21.0, 17.0))
    apart = F.array(p(23.25, 19.0), p(21.25, 21.0), p(19.25, 19.0), p(21.25, 17.0))
    d = spark.range(1).select(touching.alias("a"), apart.alias("b"))
    assert tuple(d.select(*[spatial.polygon_meets_box(c, 10.0, 20.0, 10.0, 18.0) for c in "ab"]).first()) == (True, False)


def test_point_beside_a_tip_is_outside(spark):
    """The left tip is at 3.9000000000000004, where the interpolated crossing rounds to 3.9."""
    ring = [(10.9, 15.6), (7.4, 18.6), (7.4 - 3.5, 15.6), (7.4, 12.6)]
    areas = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], "a int, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 3.9, 15.6), (2, 4.0, 15.6), (3, 10.9, 15.6)], "p int, x double, y double")
    assert [tuple(r) for r in covering.points_in_areas(points, areas, "rings", 1.0, ["p"], ["a"]).collect()] == [(2, 1)]


@pytest.mark.parametrize("crowded", [0, 1 << 40])
def test_no_pair_is_tested_by_itself(spark, monkeypatch, crowded):
    """Squares tested alone and many at once, over the borders of batches, hit what the expression of a pair hits."""
    def pair(*args):
        raise AssertionError("a pair was tested by itself")

    rng = np.random.default_rng(4)
    ring = lambda n: [{"x": float(a), "y": float(b)} for a, b in np.round(rng.uniform(-2, 4, (n, 2)) * 4) / 4]
    areas = spark.createDataFrame([(k, [ring(3 + k % 5), ring(4)][: 1 + k % 2]) for k in range(40)] * 2, f"a int, rings {RINGS}")
    rows = [(i, None if i % 9 == 0 else float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(-2, 4, (400, 2)) * 8) / 8)]
    points = spark.createDataFrame([*rows, *rows[:50]], "p int, x double, y double")
    p = points.where("x IS NOT NULL").select(F.col("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.floor("x").alias("cx"), F.floor("y").alias("cy"))
    met = covering._with_blocks(p).join(covering.covering(areas, "rings", 1.0, ["a"]), ["level", "cx", "ky"])
    met = met.where(covering._inside(F.col("px"), F.col("py"), 1.0)).select("p", "area.a", F.explode(F.sequence(F.lit(1), F.col("area.copies").cast("int"))))
    want = sorted((r["p"], r["a"]) for r in met.collect())
    monkeypatch.setattr(covering, "_inside", pair)
    monkeypatch.setattr(covering, "CROWDED", crowded)
    monkeypatch.setattr(covering, "PAIRS", 50)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = covering.points_in_areas(points, areas, "rings", 1.0, ["p"], ["a"])
        assert got.columns == ["p", "a"] and sorted(map(tuple, got.collect())) == want and len(want) > 4000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_crowded_block_is_met_in_squares(spark, monkeypatch):
    """A block with many points and areas is dealt to several tasks, and every pair is found once."""
    monkeypatch.setattr(covering, "SIDE", 10)
    points = spark.range(70).selectExpr("id AS p", "5D + (id % 10) / 20D AS x", "5.25D AS y")
    areas = spark.range(45).selectExpr("id AS a", "array(array(named_struct('x', 4.9D, 'y', 4.9D), named_struct('x', 5.22D, 'y', 4.9D), named_struct('x', 5.22D, 'y', 5.9D), named_struct('x', 4.9D, 'y', 5.9D))) AS rings")
    o = covering.points_in_areas(points, areas, "rings", 1.0, ["p"], ["a"])
    rows = [tuple(r) for r in o.collect()]
    assert len(rows) == len(set(rows)) == 35 * 45
    assert o.rdd.getNumPartitions() > 30 and max(o.rdd.glom().map(len).collect()) < 35 * 45 / 4


def test_points_off_the_lattice_take_its_border_without_a_search(spark, monkeypatch):
    searched = []
    search = spatial.nearest_point
    monkeypatch.setattr(spatial, "nearest_point", lambda df, *a, **k: searched.append(df.count()) or search(df, *a, **k))
    c = spark.range(60).selectExpr("id AS cell", "id % 10 + 0.5D AS x", "id div 10 + 0.5D AS y")
    p = spark.range(400).selectExpr("id AS p", "(id * 37 % 101) / 3.7D - 9.03D AS px", "(id * 53 % 97) / 4.1D - 8.07D AS py")
    for cells, most in ((c, 0), (c.where("cell NOT IN (0, 59, 25)"), 150)):
        at = [(r["cell"], r["x"], r["y"]) for r in cells.collect()]
        got = spatial.nearest_on_lattice(p, cells, 1.0, "px", "py", "cell").collect()
        assert len(got) == 400 and searched[-1] <= most
        for r in got:
            assert r["src_cell"] == min(((x - r["px"]) ** 2 + (y - r["py"]) ** 2, k) for k, x, y in at)[1]
