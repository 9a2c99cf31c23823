"""Raster filters, flux divergence, wind-frame composites, resampling, profile fits and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import geodesy as geo
from skylattice.functions.special import HORNER
from skylattice.operators import budget, flux, labels, profile_fit, raster, regression, resample, rotate, statistics, variogram
from skylattice.operators.materialise import materialise
from skylattice.plans import views as v
from skylattice.plans.observe import NROWS, mirror
from skylattice.plans.registry import query
from skylattice.plans.space import _FILLED, filled_mean
from skylattice.settings import MOLAR_MASS_NO2, WindFrame

TAU_S, RATIO, CORE_KM = 2.0 * 3600, 1.32, 10.0
FRAME = WindFrame()


def rnd(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


R_SRC = "sqrt(pow((lon - 73.54e0) * 111.32e0 * cos(radians(18.9e0)), 2) + pow((lat - 18.9e0) * 110.574e0, 2))"


def r_source():
    return geo.distance_km("lat", "lon", F.lit(v.SOURCE[0]), F.lit(v.SOURCE[1]))


def with_lat_lon(df):
    return df.withColumn("lat", F.lit(v.LAT_TOP) - F.lit(v.RES) * F.col("iy")).withColumn("lon", F.lit(v.LON_LEFT) + F.lit(v.RES) * F.col("ix"))


# ---------------------------------------------------------------- raster windows
def _smooth_sql(src: str, size: int, value: str = "z", keys: str = "") -> str:
    h = size // 2
    on = "".join(f"f.{k} = e.{k} AND " for k in keys.split(",") if k)
    kk = "".join(f"e.{k}, " for k in keys.split(",") if k)
    return f"""SELECT {kk}e.iy, e.ix, avg(f.{value}) AS {value} FROM {src} e CROSS JOIN (SELECT a.i AS a, b.i AS b FROM (SELECT unnest(range({-h}, {h + 1})) AS i) a, (SELECT unnest(range({-h}, {h + 1})) AS i) b) off
    CROSS JOIN (SELECT {NROWS} AS nr) nn JOIN {src} f ON {on}f.iy = {mirror('e.iy + a', 'nr')} AND f.ix = {mirror('e.ix + b', '15')} GROUP BY ALL"""


@query(f"WITH {_FILLED} SELECT iy, ix, round(z, 6) AS z FROM ({_smooth_sql('f', 3)})")
def box_smooth_3(spark, sf):
    """3 x 3 mean of the mean-filled map, mirrored edges."""
    return rnd(raster.box_mean(filled_mean(spark, sf), v.grid(spark, sf), 3, "z"), 6, "z")


@query(f"WITH {_FILLED}, z0 AS (SELECT iy, ix, coalesce(raw, 0) AS z FROM f) SELECT iy, ix, round(z, 6) AS z FROM ({_smooth_sql('z0', 5)})")
def box_smooth_5(spark, sf):
    """5 x 5 mean of the zero-filled map."""
    m = raster.fill_missing(filled_mean(spark, sf).select("iy", "ix", F.col("raw").alias("z")), "z", "zero")
    return rnd(raster.box_mean(m, v.grid(spark, sf), 5, "z"), 6, "z")


@query(f"""WITH {_FILLED}, s AS ({_smooth_sql('f', 3)}), c AS (SELECT quantile_cont(z, 0.8) AS q FROM s),
  t AS (SELECT e.iy, e.ix, any_value(e.z) AS z, max(g.z) AS top FROM s e CROSS JOIN (SELECT a.i AS a, b.i AS b FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b) off CROSS JOIN (SELECT {NROWS} AS nr) nn
    JOIN s g ON g.iy = {mirror('e.iy + a', 'nr')} AND g.ix = {mirror('e.ix + b', '15')} GROUP BY ALL)
  SELECT iy, ix, round(z, 6) AS z FROM t, c WHERE z = top AND z > q ORDER BY z DESC LIMIT 4""")
def local_peaks(spark, sf):
    """Top four local maxima above a quantile of the smoothed map."""
    g = v.grid(spark, sf)
    # the smoothed map is reused three times: rounding makes equal values equal on every path
    s = raster.box_mean(filled_mean(spark, sf), g, 3, "z")
    return rnd(raster.local_peaks(s, g, 5, 0.8, "z").orderBy(F.desc("z")).limit(4), 6, "z").select("iy", "ix", "z")


# ---------------------------------------------------------------- flux divergence
_DX = "(2e-2 * 111.32e0 * cos(radians(19e0 - 2e-2 * (nr - 1) / 2)) * 1000)"
_DY = "(2e-2 * 110.574e0 * 1000)"
_PART = "part_ AS (SELECT overpass, iy, ix, sum(value) AS sv, count(*) AS n FROM cube WHERE value IS NOT NULL GROUP BY ALL)"
_BG = "bg AS (SELECT quantile_cont(m, 0.1) AS b10, quantile_cont(m, 0.05) AS b5, quantile_cont(m, 0.25) AS b25 FROM (SELECT iy, ix, avg(value) AS m FROM cube GROUP BY ALL))"


#: Resamples of maps and rates, draws of the label-error field, and resamples of a seasonal fit.
RESAMPLES = 200
ERROR_DRAWS = 30
SEASONAL_RESAMPLES = 100


def _weights_sql(reps: int, seed: int = 42, units: str = "wind") -> str:
    return f"""u_ AS (SELECT overpass, row_number() OVER (ORDER BY md5(CAST(overpass AS VARCHAR)), overpass) - 1 AS slot, count(*) OVER () AS n FROM {units}),
  dr AS (SELECT rep, CAST(floor((CAST('0x' || substr(md5('{seed}:' || rep || ':' || slot), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 * n) AS BIGINT) AS slot FROM u_, (SELECT unnest(range(1, {reps + 1})) AS rep)),
  wt AS (SELECT rep, overpass, CAST(count(*) AS DOUBLE) AS w FROM dr JOIN u_ USING (slot) GROUP BY ALL UNION ALL SELECT 0, overpass, 1e0 FROM {units})"""


def _flux_sql(key: str = "rep") -> str:
    return f"""fl AS (SELECT {key}, iy, ix, sum(w * sv * u) / sum(w * n) AS fx, sum(w * sv * v) / sum(w * n) AS fy, sum(w * sv) / sum(w * n) AS vb FROM part_ JOIN wind USING (overpass) JOIN wt USING (overpass) GROUP BY ALL),
  dn AS (SELECT k.{key}, p.iy, p.ix, p.lat, p.lon, fx, fy, vb, nr FROM (SELECT DISTINCT {key} FROM fl) k CROSS JOIN pix p CROSS JOIN (SELECT {NROWS} AS nr) LEFT JOIN fl ON fl.{key} = k.{key} AND fl.iy = p.iy AND fl.ix = p.ix),
  gr AS (SELECT *, CASE WHEN fx IS NULL THEN NULL WHEN ix = 0 THEN (lead(fx) OVER wx - fx) / {_DX} WHEN ix = 14 THEN (fx - lag(fx) OVER wx) / {_DX} ELSE (lead(fx) OVER wx - lag(fx) OVER wx) / (2 * {_DX}) END AS gx,
    CASE WHEN fy IS NULL OR nr < 2 THEN NULL WHEN iy = 0 THEN (lead(fy) OVER wy - fy) / -{_DY} WHEN iy = nr - 1 THEN (fy - lag(fy) OVER wy) / -{_DY} ELSE (lead(fy) OVER wy - lag(fy) OVER wy) / (-2 * {_DY}) END AS gy
    FROM dn WINDOW wx AS (PARTITION BY {key}, iy ORDER BY ix), wy AS (PARTITION BY {key}, ix ORDER BY iy)),
  em AS (SELECT {key}, iy, ix, lat, lon, nr, vb, gx + gy AS div, (vb - b10) / 7200e0 AS sink, 1.32e0 * (gx + gy + (vb - b10) / 7200e0) AS e FROM gr, bg)"""


_ONE = "wt AS (SELECT 0 AS rep, overpass, 1e0 AS w FROM wind)"


def background(spark, sf, cube=None):
    """One row: low quantiles of the pixel means."""
    from skylattice.operators.quantiles import exact_quantiles

    px = (cube if cube is not None else v.screened(spark, sf)).groupBy("iy", "ix").agg(F.avg("value").alias("m"))
    return exact_quantiles(px, [], "m", {"b10": 0.1, "b5": 0.05, "b25": 0.25})


def attach_one(df, one):
    """Columns of a one-row table on every row."""
    return df.withColumn("__k", F.lit(0)).join(F.broadcast(one.withColumn("__k", F.lit(0))), "__k").drop("__k")


def maps(spark, sf, weights=None, keys=()):
    c = v.screened(spark, sf)
    fl = attach_one(flux.mean_flux(c, v.winds(spark, sf), weights, keys), background(spark, sf, c))
    return flux.emission_map(fl, v.grid(spark, sf), TAU_S, F.col("b10"), RATIO, keys)


@query(f"WITH {v.CUBE}, {v.WIND}, {v.PIX}, {_PART}, {_BG}, {_ONE}, {_flux_sql()} SELECT iy, ix, round(vb, 8) AS vbar, round(div, 8) AS div, round(sink, 8) AS sink, round(e, 8) AS emission FROM em")
def flux_divergence_map(spark, sf):
    """Emission map: divergence of the mean flux plus the sink of the enhancement over the p10 background."""
    return rnd(maps(spark, sf), 8, "vbar", "div", "sink", "emission")


_ZONES = f"""zt AS (SELECT rep, 'r' || CAST(k AS VARCHAR) || 'km' AS zone, sum(e) * {_DX} * {_DY} * 46.0055e-3 AS total FROM em, (SELECT unnest([5, 10, 15]) AS k) WHERE {R_SRC} <= k GROUP BY rep, nr, k)"""


@query(f"""WITH {v.CUBE}, {v.WIND}, {v.PIX}, {_PART}, {_BG}, {_weights_sql(RESAMPLES)}, {_flux_sql()}, {_ZONES}
  SELECT zone, round(max(CASE WHEN rep = 0 THEN total END), 3) AS estimate, round(quantile_cont(CASE WHEN rep > 0 THEN total END, 0.025), 3) AS lo, round(quantile_cont(CASE WHEN rep > 0 THEN total END, 0.975), 3) AS hi FROM zt GROUP BY 1""")
def divergence_totals_ci(spark, sf):
    """Radius totals of the emission map with a bootstrap over overpasses: main map and resamples in one job."""
    w = v.winds(spark, sf)
    wt = resample.with_main(resample.multinomial_weights(w, "overpass", RESAMPLES, 42), w, "overpass")
    m = with_lat_lon(maps(spark, sf, wt, ["rep"]))
    from skylattice.operators.spatial import zone_totals

    z = zone_totals(m, {f"r{k}km": r_source() <= k for k in (5, 10, 15)}, flux.mass_rate(v.grid(spark, sf)), ["rep"])
    return rnd(resample.interval(z, ["zone"], "total", {"lo": 0.025, "hi": 0.975}), 3, "estimate", "lo", "hi")


@query(f"""WITH {v.CUBE}, {v.WIND}, {v.PIX}, {_PART}, {_BG}, {_ONE}, {_flux_sql()},
  va AS (SELECT unnest([{{'variant': 'main', 'tau': 7200e0, 'b': b10}}, {{'variant': 'tau x0.7', 'tau': 7200e0 * 7e-1, 'b': b10}}, {{'variant': 'tau x1.3', 'tau': 7200e0 * 1.3e0, 'b': b10}},
    {{'variant': 'tau / 0.84', 'tau': 7200e0 / 84e-2, 'b': b10}}, {{'variant': 'background p5', 'tau': 7200e0, 'b': b5}}, {{'variant': 'background p25', 'tau': 7200e0, 'b': b25}}]) AS s FROM bg)
  SELECT s.variant AS variant, round(sum(1.32e0 * (div + (vb - s.b) / s.tau)) * {_DX} * {_DY} * 46.0055e-3, 3) AS total FROM em, va WHERE {R_SRC} <= 10 GROUP BY s.variant, nr""")
def divergence_sensitivity(spark, sf):
    """Total within 10 km for lifetime and background variants."""
    fl = attach_one(flux.mean_flux(v.screened(spark, sf), v.winds(spark, sf)), background(spark, sf))
    t, b = F.lit(TAU_S), F.col("b10")
    fl = flux.lifetime_background_variants(fl, [("main", t, b), ("tau x0.7", t * 0.7, b), ("tau x1.3", t * 1.3, b), ("tau / 0.84", t / 0.84, b),
                                                ("background p5", t, F.col("b5")), ("background p25", t, F.col("b25"))])
    g = v.grid(spark, sf)
    m = with_lat_lon(flux.emission_map(fl, g, F.col("tau_s"), F.col("v_bg"), RATIO, ["variant"]))
    return m.where(r_source() <= 10).groupBy("variant").agg(F.round(F.sum(flux.mass_rate(g)), 3).alias("total"))


# ---------------------------------------------------------------- static pattern, tracer
_ANOM = f"""el AS (SELECT iy, ix, 500 + 20e0 * iy + 10e0 * ix AS z FROM pix), zs AS ({_smooth_sql('el', 5)}),
  a0 AS (SELECT c.overpass, c.iy, c.ix, c.value / exp(-zs.z / 8400e0) AS x FROM cube c JOIN zs ON c.iy = zs.iy AND c.ix = zs.ix),
  a1 AS (SELECT *, x - quantile_cont(x, 0.5) OVER (PARTITION BY overpass) AS y FROM a0), a2 AS (SELECT *, y - avg(y) OVER (PARTITION BY iy, ix) AS value FROM a1)"""


def tracer(spark, sf):
    """Screened observations with terrain, overpass median and pixel mean removed."""
    g = v.grid(spark, sf)
    el = raster.pixel_grid(spark, g).select("iy", "ix", (F.lit(500.0) + 20.0 * F.col("iy") + 10.0 * F.col("ix")).alias("elevation_m"))
    el = raster.box_mean(el, g, 5, "elevation_m")
    return flux.static_pattern_removed(v.screened(spark, sf), el, 8.4)


@query(f"WITH {v.CUBE}, {v.PIX}, {_ANOM} SELECT iy, ix, overpass, round(sum(value), 5) AS anomaly, count(value) AS n FROM a2 GROUP BY ALL")
def anomaly_static_removed(spark, sf):
    """Terrain-normalised anomaly minus the overpass median minus the pixel mean."""
    return tracer(spark, sf).groupBy("iy", "ix", "overpass").agg(F.round(F.sum("value"), 5).alias("anomaly"), F.count("value").alias("n"))


@query(f"""WITH {v.CUBE}, {v.PIX}, {v.WIND}, {_ANOM}, {_ONE}, part_ AS (SELECT overpass, iy, ix, sum(value) AS sv, count(*) AS n FROM a2 WHERE value IS NOT NULL GROUP BY ALL), bg AS (SELECT 0e0 AS b10), {_flux_sql()},
  tr AS (SELECT iy, ix, coalesce(div, 0) AS z FROM em), s1 AS ({_smooth_sql('tr', 5)}) SELECT iy, ix, round(z, 7) AS z FROM s1""")
def tracer_divergence(spark, sf):
    """Inert-tracer flux divergence (no sink, zero background), zero-filled and smoothed."""
    fl = flux.mean_flux(tracer(spark, sf), v.winds(spark, sf))
    g = v.grid(spark, sf)
    m = flux.emission_map(fl, g, 1e15, 0.0, 1.0).select("iy", "ix", F.col("div").alias("z"))
    return rnd(raster.box_mean(raster.fill_missing(m, "z", "zero"), g, 5, "z"), 7, "z")


# ---------------------------------------------------------------- wind frame
_ROT = """dxy AS (SELECT c.overpass, c.value, w.u, w.v, (lon - 73.54e0) * 111.32e0 * cos(radians(18.9e0)) AS dx, (lat - 18.9e0) * 110.574e0 AS dy FROM cube c JOIN wind w USING (overpass) WHERE c.value IS NOT NULL),
  rt AS (SELECT overpass, value, dx * cos(atan2(v, u)) + dy * sin(atan2(v, u)) AS al, -dx * sin(atan2(v, u)) + dy * cos(atan2(v, u)) AS ac FROM dxy),
  rb AS (SELECT overpass, CAST(floor((al + 40) / 2) AS INTEGER) AS ia, CAST(floor((ac + 20) / 2) AS INTEGER) AS ic, sum(value) AS s, count(*) AS n FROM rt WHERE al >= -40 AND al < 60 AND ac >= -20 AND ac < 20 GROUP BY ALL)"""
_SPEED = "sqrt(u * u + v * v)"


def rotated(spark, sf):
    return rotate.rotate_bin(v.screened(spark, sf), v.winds(spark, sf), v.SOURCE, FRAME)


def windy(spark, sf):
    w = v.winds(spark, sf)
    ws = geo.wind_speed("u", "v")
    return w.where((ws >= FRAME.windy_min) & (ws <= FRAME.windy_max))


@query(f"WITH {v.CUBE}, {v.WIND}, {_ROT} SELECT overpass, ia, ic, round(s, 6) AS s, n FROM rb")
def rotated_bins(spark, sf):
    """Per-overpass sums and counts in wind-frame bins."""
    return rnd(rotated(spark, sf), 6, "s")


_REGIMES = f"""rg AS (SELECT regime, overpass FROM (SELECT overpass, {_SPEED} AS ws, ((270 - degrees(atan2(v, u))) % 360 + 360) % 360 AS wd FROM wind) x,
  LATERAL (SELECT unnest([CASE WHEN ws < 2 THEN 'calm' END, CASE WHEN ws >= 2 AND ws <= 8 THEN 'windy' END, CASE WHEN ws >= 2 AND ws <= 8 AND wd >= 45 AND wd < 180 THEN 'east' END, CASE WHEN ws >= 2 AND ws <= 8 AND wd >= 225 THEN 'west' END]) AS regime) y WHERE regime IS NOT NULL)"""


def regimes(spark, sf):
    ws, wd = geo.wind_speed("u", "v"), geo.wind_from_deg("u", "v")
    fast = (ws >= 2) & (ws <= 8)
    return rotate.wind_regimes(v.winds(spark, sf), {"calm": ws < 2, "windy": fast, "east": fast & (wd >= 45) & (wd < 180), "west": fast & (wd >= 225)})


@query(f"WITH {v.WIND}, {_REGIMES} SELECT regime, count(*) AS n FROM rg GROUP BY 1")
def wind_regimes(spark, sf):
    """Overlapping named wind regimes in one pass."""
    return regimes(spark, sf).groupBy("regime").agg(F.count("*").alias("n"))


_LINE = """fd AS (SELECT {k}, ia, ic, sum(w * s) / sum(w * n) AS f FROM rb JOIN wt USING (overpass) GROUP BY ALL), ld AS (SELECT {k}, ia, -40 + (ia + 5e-1) * 2 AS x, avg(f) * 40000e0 AS l FROM fd GROUP BY ALL)"""
_RWT = "wt AS (SELECT regime, overpass, 1e0 AS w FROM rg)"


@query(f"WITH {v.CUBE}, {v.WIND}, {_ROT}, {_REGIMES}, {_RWT}, {_LINE.format(k='regime')} SELECT regime, ia, round(x, 6) AS along, round(l, 3) AS line_density FROM ld")
def line_density(spark, sf):
    """Line density of every wind regime."""
    w = regimes(spark, sf).select("regime", "overpass", F.lit(1.0).alias("w"))
    return rnd(rnd(rotate.line_density(rotated(spark, sf), w, ["regime"], FRAME), 6, "along"), 3, "line_density")


@query(f"""WITH {v.CUBE}, {v.WIND}, {_ROT}, wy AS (SELECT * FROM wind WHERE {_SPEED} >= 2 AND {_SPEED} <= 8), {_weights_sql(RESAMPLES, 7, 'wy')}, {_LINE.format(k='rep')},
  st AS (SELECT rep, avg(CASE WHEN x BETWEEN 4 AND 14 THEN l END) - avg(CASE WHEN x BETWEEN -14 AND -4 THEN l END) AS step FROM ld GROUP BY 1),
  iw AS (SELECT rep, sum(w / {_SPEED}) / sum(w) AS i FROM wt JOIN wy USING (overpass) GROUP BY 1), r AS (SELECT rep, step / i AS rate FROM st JOIN iw USING (rep))
  SELECT round(max(CASE WHEN rep = 0 THEN rate END), 2) AS estimate, round(quantile_cont(CASE WHEN rep > 0 THEN rate END, 0.025), 2) AS lo, round(quantile_cont(CASE WHEN rep > 0 THEN rate END, 0.975), 2) AS hi,
    round(stddev_pop(CASE WHEN rep > 0 THEN rate END) / nullif(avg(CASE WHEN rep > 0 THEN rate END), 0), 6) AS rel_sd FROM r""")
def bootstrap_ci(spark, sf):
    """Step estimate of an inert tracer with a bootstrap interval over windy overpasses."""
    w = windy(spark, sf)
    wt = resample.with_main(resample.multinomial_weights(w, "overpass", RESAMPLES, 7), w, "overpass")
    frame = WindFrame(upwind=(-14.0, -4.0), downwind=(4.0, 14.0))
    lines = rotate.line_density(rotated(spark, sf), wt, ["rep"], frame)
    s = rotate.step_estimate(lines, rotate.mean_inverse_wind(wt, w, ["rep"]), ["rep"], frame)
    return rnd(rnd(resample.interval(s, [], "rate", {"lo": 0.025, "hi": 0.975}, "rel_sd"), 2, "estimate", "lo", "hi"), 6, "rel_sd")


@query(f"""WITH {v.CUBE}, {v.WIND}, {_ROT}, wt AS (SELECT 'all' AS k, overpass, 1e0 AS w FROM wind), {_LINE.format(k='k')}, iw AS (SELECT avg(1 / {_SPEED}) AS i, avg({_SPEED}) AS m FROM wind)
  SELECT round(avg(CASE WHEN x BETWEEN 4 AND 14 THEN l END) - avg(CASE WHEN x BETWEEN -14 AND -4 THEN l END), 3) AS step, round(any_value(i), 6) AS inv_wind, round(any_value(m), 6) AS mean_wind FROM ld, iw""")
def step_estimate(spark, sf):
    """Downwind minus upwind plateau of the line density."""
    w = v.winds(spark, sf)
    frame = WindFrame(upwind=(-14.0, -4.0), downwind=(4.0, 14.0))
    inv = rotate.mean_inverse_wind(w.select("overpass", F.lit(1.0).alias("w")), w)
    s = rotate.step_estimate(rotate.line_density(rotated(spark, sf), frame=frame), inv, (), frame)
    return rnd(rnd(s.drop("rate"), 3, "step"), 6, "inv_wind", "mean_wind")


@query(f"""WITH {v.CUBE}, {v.WIND}, {v.PIX}, cm AS (SELECT iy, ix, avg(value) AS m FROM cube WHERE overpass IN (SELECT overpass FROM wind WHERE {_SPEED} < 3) GROUP BY ALL), mm AS (SELECT avg(m) AS g FROM cm),
  f AS (SELECT p.iy, p.ix, coalesce(cm.m, mm.g) AS z FROM pix p CROSS JOIN mm LEFT JOIN cm ON p.iy = cm.iy AND p.ix = cm.ix), s AS ({_smooth_sql('f', 3)})
  SELECT s.iy, s.ix, round(lat, 6) AS lat, round(lon, 6) AS lon, round(z, 6) AS comp FROM s JOIN pix USING (iy, ix) WHERE {R_SRC} <= 15 ORDER BY z DESC, s.iy, s.ix LIMIT 1""")
def source_location(spark, sf):
    """Pixel of the largest smoothed calm composite near the city centre."""
    w = v.winds(spark, sf)
    calm = v.screened(spark, sf).join(w.where(geo.wind_speed("u", "v") < 3).select("overpass"), "overpass", "left_semi")
    return rnd(rotate.locate_source(calm, v.grid(spark, sf), v.SOURCE, 15.0), 6, "lat", "lon", "comp")


# ---------------------------------------------------------------- profile fits
def _erfcx_sql(z: str) -> str:
    s = f"(4e0 / (2 + {z}) - 1)"
    p = f"({HORNER[-1]!r})"
    for c in reversed(HORNER[:-1]):
        p = f"({p} * s_ + ({c!r}))"
    return s, p


_S, _P = _erfcx_sql("abs(z)")
_NODES = """nd AS (SELECT k AS node, 2e0 * pow(150e0 / 2, (k // 36) / 7e0) AS x0, -15 + 30e0 * (k // 6 % 6) / 5e0 AS mu, pow(30e0, (k % 6) / 5e0) AS sg FROM (SELECT unnest(range(288)) AS k))"""


@query(f"""WITH {v.CUBE}, {v.WIND}, {_ROT}, {_REGIMES}, {_RWT}, {_LINE.format(k='regime')}, {_NODES},
  a AS (SELECT regime, x, l, node, x0, mu, sg, (sg / x0 - (x - mu) / sg) / sqrt(2e0) AS z, sg * sg / (2 * x0 * x0) - (x - mu) / x0 AS ex FROM ld, nd WHERE x <= 45),
  b AS (SELECT *, {_S} AS s_ FROM a), c AS (SELECT *, (2e0 / (2 + abs(z))) * exp({_P}) AS cx FROM b),
  d AS (SELECT *, (CASE WHEN z > 0 THEN exp(least(ex - z * z, 700)) * cx ELSE exp(least(ex, 700)) * (2 - exp(-z * z) * cx) END) / (2 * x0) / 1000 AS f FROM c),
  s AS (SELECT regime, node, any_value(x0) AS x0, any_value(mu) AS mu, any_value(sg) AS sigma, count(*) * 1e0 AS n, sum(f) AS sf, sum(f * f) AS sff, sum(l) AS sl, sum(f * l) AS sfl, sum(l * l) AS sll, min(l) AS lo, max(l) AS hi FROM d GROUP BY ALL),
  t AS (SELECT *, (sfl - sf * sl / n) / nullif(sff - sf * sf / n, 0) AS a FROM s), u2 AS (SELECT *, (sl - a * sf) / n AS b, greatest(hi - lo, 1e-12) AS span FROM t WHERE a IS NOT NULL),
  w2 AS (SELECT *, greatest(sll - a * sfl - b * sl, 0) AS sse, CASE WHEN a < 0 OR a > span * 3e5 OR b < lo - span OR b > hi + span THEN 1 ELSE 0 END AS bad FROM u2)
  SELECT regime, round(x0, 6) AS x0, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(a, 0) AS a, round(1 - sse / nullif(sll - sl * sl / n, 0), 6) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY bad, sse, node) AS rn FROM w2) WHERE rn = 1""")
def profile_fit_grid(spark, sf):
    """Coarse-grid fit of the peaked profile with flat background, one fit per wind regime."""
    w = regimes(spark, sf).select("regime", "overpass", F.lit(1.0).alias("w"))
    fit = profile_fit.fit_profiles(rotate.line_density(rotated(spark, sf), w, ["regime"], FRAME), ["regime"], sloped=False, rounds=1, shape=(8, 6, 6))
    return rnd(fit.select("regime", "x0", "mu", "sigma", F.round("a", 0).alias("a"), "r2"), 6, "x0", "mu", "sigma", "r2")


def seasonal_fits(spark, sf, reps: int):
    """Sloped and flat fits of every (season, replicate) profile, with emission rates and intervals."""
    w = windy(spark, sf).withColumn("season", F.expr("overpass div 10").cast("int"))
    wt = resample.with_main(resample.multinomial_weights(w, "overpass", reps, 42, ["season"]), w, "overpass", ["season"])
    wt = materialise(wt)
    lines = materialise(rotate.line_density(rotated(spark, sf), wt, ["season", "rep"], FRAME))
    wind = materialise(rotate.mean_inverse_wind(wt, w, ["season", "rep"]))
    fits = []
    for sloped in (True, False):
        e = profile_fit.emissions(profile_fit.fit_profiles(lines, ["season", "rep"], sloped=sloped, rounds=4).join(wind, ["season", "rep"]))
        fits.append(resample.interval(e, ["season"], "e_nox_kg_s", {"ci_lo": 0.025, "ci_med": 0.5, "ci_hi": 0.975}, "rel_sd",
                                      main_cols=["x0", "r2", "tau_h", "e_nox_kg_s", "e_nox_kt_yr"]).drop("estimate"))
    return profile_fit.choose_constrained(fits[0], fits[1], ["season"])


@query()
def seasonal_emissions(spark, sf):
    """Per-season rate, lifetime and bootstrap interval, with the flat-background fallback flagged."""
    return seasonal_fits(spark, sf, SEASONAL_RESAMPLES)


@query()
def between_within_seasons(spark, sf):
    """Spread of the seasonal rates over their mean uncertainty."""
    s = seasonal_fits(spark, sf, SEASONAL_RESAMPLES).withColumn("sigma", (F.col("ci_hi") - F.col("ci_lo")) / 2 / 1.96)
    return statistics.between_within(s, "e_nox_kg_s", "sigma")


@query()
def fit_setting_sweep(spark, sf):
    """Spread of the fitted rate over search-grid settings."""
    w = windy(spark, sf).withColumn("k", F.lit(0))
    wt = w.select("k", "overpass", F.lit(1.0).alias("w"))
    lines = materialise(rotate.line_density(rotated(spark, sf), wt, ["k"], FRAME))
    wind = materialise(rotate.mean_inverse_wind(wt, w, ["k"]))
    fits = None
    for shape in ((8, 6, 6), (12, 8, 8)):
        for rounds in (2, 3):
            f = profile_fit.emissions(profile_fit.fit_profiles(lines, ["k"], sloped=False, rounds=rounds, shape=shape).join(wind, "k"))
            fits = f if fits is None else fits.unionByName(f)
    return profile_fit.settings_spread(fits, "e_nox_kg_s", F.col("e_nox_kg_s"))


# ---------------------------------------------------------------- labels
_SEASONS = """se AS (SELECT CAST(overpass // 10 AS INTEGER) AS season, avg(value) / 100 AS e, quantile_cont(value, 0.25) / 100 AS lo, quantile_cont(value, 0.75) / 100 AS hi FROM cube WHERE value IS NOT NULL GROUP BY 1)"""


def _density_sql(size: int = 5) -> str:
    return f"""tot AS (SELECT rep, sum(e) * {_DX} * {_DY} * 46.0055e-3 AS total FROM em WHERE {R_SRC} <= 10 GROUP BY rep, nr),
  ez AS (SELECT rep, iy, ix, coalesce(e, 0) AS z FROM em), sm AS ({_smooth_sql('ez', size, 'z', 'rep')}),
  ck AS (SELECT *, CAST(least(floor(gy), nr - 2) AS INTEGER) AS j, CAST(least(floor(gx), 13) AS INTEGER) AS i, gy >= 0 AND gy <= nr - 1 AND gx >= 0 AND gx <= 14 AS inside
    FROM (SELECT cell_id, x, y, (19e0 - lat) / 2e-2 AS gy, (lon - 73.4e0) / 2e-2 AS gx, nr FROM cells, (SELECT {NROWS} AS nr))),
  ds AS (SELECT k.cell_id, k.x, k.y, a.rep, CASE WHEN inside THEN (1 - (gy - j)) * (1 - (gx - i)) * a.z + (1 - (gy - j)) * (gx - i) * b.z + (gy - j) * (1 - (gx - i)) * c_.z + (gy - j) * (gx - i) * d.z END * 46.0055e-3 / total AS dens
    FROM ck k JOIN sm a ON a.iy = j AND a.ix = i JOIN sm b ON b.iy = j AND b.ix = i + 1 AND b.rep = a.rep JOIN sm c_ ON c_.iy = j + 1 AND c_.ix = i AND c_.rep = a.rep
    JOIN sm d ON d.iy = j + 1 AND d.ix = i + 1 AND d.rep = a.rep JOIN tot ON tot.rep = a.rep WHERE inside)"""


def densities(spark, sf, reps: int, size: int = 5):
    """Cell densities of the main map and of `reps` resampled maps."""
    w = v.winds(spark, sf)
    wt = resample.with_main(resample.multinomial_weights(w, "overpass", reps, 42) if reps else None, w, "overpass")
    m, g = with_lat_lon(maps(spark, sf, wt, ["rep"])), v.grid(spark, sf)
    tot = labels.city_total(m, g, r_source() <= CORE_KM, MOLAR_MASS_NO2, ["rep"])
    return labels.share_density(m, tot, g, v.cells(spark, sf), "cell_id", size, ["rep"], MOLAR_MASS_NO2)


@query(f"""WITH {v.CUBE}, {v.WIND}, {v.PIX}, {v.CELLS}, {_PART}, {_BG}, {_weights_sql(0)}, {_flux_sql()}, {_density_sql()} SELECT cell_id, round(dens * 1e9, 3) AS density_e9 FROM ds""")
def label_density(spark, sf):
    """Each cell's share of the city total per m2: smoothed map, bilinear, divided by the total within the radius."""
    d = densities(spark, sf, 0).where(F.col("density").isNotNull())
    return d.select("cell_id", F.round(F.col("density") * 1e9, 3).alias("density_e9"))


@query(f"""WITH {v.CUBE}, {v.WIND}, {v.PIX}, {v.CELLS}, {_PART}, {_BG}, {_weights_sql(RESAMPLES)}, {_flux_sql()}, {_density_sql()}, {_SEASONS},
  dd AS (SELECT cell_id, max(CASE WHEN rep = 0 THEN dens END) AS d, stddev_pop(CASE WHEN rep > 0 THEN dens END) AS sd FROM ds GROUP BY 1)
  SELECT cell_id, season, round(d * e * 162.7e0 * 31557600e3, 2) AS label, round(sqrt(pow(sd * e, 2) + pow(d * (hi - lo) / (2 * 1.96e0), 2)) * 162.7e0 * 31557600e3, 2) AS label_sd,
    round(d * e * 162.7e0 * 31557600e3 / 1.2e0, 2) AS label_annual FROM dd, se""")
def label_with_sd(spark, sf):
    """Cell-by-season label with its error from resampled maps and the seasonal interval."""
    from skylattice.operators.quantiles import exact_quantiles

    d = labels.density_with_sd(densities(spark, sf, RESAMPLES), "cell_id").where(F.col("density").isNotNull())
    c = v.screened(spark, sf).withColumn("season", F.expr("overpass div 10").cast("int")).where(F.col("value").isNotNull())
    q = exact_quantiles(c, ["season"], "value", {"lo": 0.25, "hi": 0.75})
    s = (c.groupBy("season").agg((F.avg("value") / 100).alias("e")).join(q, "season")
         .select("season", "e", (F.col("lo") / 100).alias("e_lo"), (F.col("hi") / 100).alias("e_hi")))
    lab = labels.assemble(d, s, 162.7, 1.2)
    return rnd(lab.select("cell_id", "season", "label", "label_sd", "label_annual"), 2, "label", "label_sd", "label_annual")


@query(f"""WITH {v.CUBE}, {v.WIND}, {v.PIX}, {v.CELLS}, {_PART}, {_BG}, {_weights_sql(ERROR_DRAWS)}, {_flux_sql()}, {_density_sql()},
  er AS (SELECT a.rep, a.cell_id, a.x, a.y, (a.dens - b.dens) * 1e9 AS z FROM ds a JOIN ds b ON a.cell_id = b.cell_id AND b.rep = 0 WHERE a.rep > 0),
  pr AS (SELECT a.rep, CAST(floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS INTEGER) AS lag, 5e-1 * pow(a.z - b.z, 2) AS g FROM er a JOIN er b ON a.rep = b.rep AND a.cell_id < b.cell_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 10),
  vg AS (SELECT rep, lag, avg(g) AS g FROM pr GROUP BY ALL) SELECT lag, round(avg(g) / 1000, 3) AS gamma, count(*) AS n_draws FROM vg GROUP BY 1""")
def error_field_variogram(spark, sf):
    """Semivariogram of the label-error field (resampled minus main map), averaged over draws."""
    d = densities(spark, sf, ERROR_DRAWS).where(F.col("density").isNotNull())
    err = variogram.error_field(d, ["cell_id"], "density").withColumn("error", F.col("error") * 1e9)
    err = err.join(v.cells(spark, sf).select("cell_id", "x", "y"), "cell_id")
    vg = variogram.mean_over_draws(variogram.semivariogram(err, "error", 10.0, 1.0, ["rep"]))
    return vg.select("lag", F.round(F.col("gamma") / 1000, 3).alias("gamma"), "n_draws")


# ---------------------------------------------------------------- budgets
def _uni(tag: str, row: str, i: str = "") -> str:
    tail = f" || ':{i}'" if i else ""
    return f"((CAST('0x' || substr(md5('7:{tag}:' || {row} || ':' || draw{tail}), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0)"


def _norm(tag: str, row: str) -> str:
    return f"(sqrt(-2 * ln({_uni(tag, row, '1')})) * cos(2 * pi() * {_uni(tag, row, '2')}))"


@query(f"""WITH e AS (SELECT c_nationkey AS zone, sum(c_acctbal) / 1e4 AS x, sum(abs(c_acctbal)) / 1.2e4 AS other FROM customer GROUP BY 1),
  d AS (SELECT zone, x, other, draw, exp({_norm('wind', 'zone')} * ln(1 + 0.08e0)) AS a, (1.32e0 + 0.1e0 * {_norm('ratio', 'zone')}) / 1.32e0 AS b, exp({_norm('bias', 'zone')} * ln(1 + 0.12e0)) AS c1,
    1 / (1 + 0.115e0 + 0.03e0 * {_norm('offset', 'zone')}) AS c2, 1 / (1.1e0 + (1.3e0 - 1.1e0) * {_uni('factor', 'zone')}) AS f FROM e, (SELECT unnest(range(1, 501)) AS draw)),
  v AS (SELECT zone, other, 'symmetric' AS variant, x * a * b * c1 * f AS y FROM d UNION ALL SELECT zone, other, 'bias-corrected', x * a * b * c2 * f FROM d),
  q AS (SELECT zone, other, variant, quantile_cont(y, 0.025) AS a, quantile_cont(y, 0.16) AS b, quantile_cont(y, 0.5) AS c, quantile_cont(y, 0.84) AS d, quantile_cont(y, 0.975) AS e FROM v GROUP BY ALL)
  SELECT zone, variant, round(a, 5) AS p2_5, round(b, 5) AS p16, round(c, 5) AS p50, round(d, 5) AS p84, round(e, 5) AS p97_5, other BETWEEN a AND e AS inside_95 FROM q""")
def uncertainty_draws(spark, sf):
    """Error propagation by hashed draws for a table of zone estimates, two bias treatments."""
    T = budget.Term
    common = [T("wind", "lognormal", 0.08), T("ratio", "normal", 1.32, 0.1)]
    factor = T("factor", "uniform", 1.1, 1.3)
    variants = {"symmetric": [*common, T("bias", "lognormal", 0.12), factor], "bias-corrected": [*common, T("offset", "inverse_bias", 0.115, 0.03), factor]}
    e = v.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg((F.sum("c_acctbal") / 1e4).alias("x"), (F.sum(F.abs("c_acctbal")) / 1.2e4).alias("other"))
    return rnd(budget.propagate(e, "zone", "x", variants, 500, 7, compare="other").drop("other"), 5, "p2_5", "p16", "p50", "p84", "p97_5")


@query("""WITH b AS (SELECT n_regionkey, s_nationkey, stddev_pop(s_acctbal) / nullif(avg(abs(s_acctbal)), 0) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
  r AS (SELECT n_regionkey, s_nationkey, avg(s_acctbal) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), w AS (SELECT n_regionkey, (max(m) - min(m)) / nullif(2 * max(CASE WHEN s_nationkey = n_regionkey THEN m END), 0) AS h FROM r GROUP BY 1)
  SELECT n_regionkey, round(sqrt(sum(s * s)), 6) AS total_rel_sigma, round(any_value(h), 6) AS half_range FROM b JOIN w USING (n_regionkey) GROUP BY 1""")
def budget_total(spark, sf):
    """Root sum of squares of relative terms, and the half range of sensitivity runs."""
    j = v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = j.groupBy("n_regionkey", "s_nationkey").agg((F.stddev_pop("s_acctbal") / F.nullif(F.avg(F.abs("s_acctbal")), F.lit(0.0))).alias("s"), F.avg("s_acctbal").alias("m"))
    rss = statistics.root_sum_square(b, "s", ["n_regionkey"])
    half = budget.budget_spread(b.withColumn("run", F.when(F.col("s_nationkey") == F.col("n_regionkey"), "main").otherwise("other")), "m", "main", "run", ["n_regionkey"])
    return rnd(rss.join(half.drop("main"), "n_regionkey"), 6, "total_rel_sigma", "half_range")


# ---------------------------------------------------------------- plume scaling
_SND = f"""snd AS (SELECT event_id, o.overpass AS day, (lon - 73.54e0) * 111.32e0 * cos(radians(18.9e0)) AS x, (lat - 18.9e0) * 110.574e0 AS y, value AS xco2, 1 + cloud AS unc, u, v FROM obs o JOIN wind USING (overpass) WHERE product = 'view'),
  emi AS (SELECT ex, ey, sum(r) AS rate FROM (SELECT (s_suppkey * 3 % 21 - 10) * 1e0 AS ex, (s_suppkey * 7 % 17 - 8) * 1e0 AS ey, greatest(s_acctbal, 0e0) / 1e1 AS r FROM supplier) GROUP BY ALL),
  pr AS (SELECT event_id, sum(CASE WHEN al > 0 THEN rate / (ws * sqrt(2 * pi()) * s) * exp(-5e-1 * pow(ac * 1000 / s, 2)) ELSE 0 END) AS mass FROM (SELECT *, sqrt(4 + pow(15e-2 * al, 2)) * 1000 AS s FROM (
     SELECT event_id, rate, sqrt(u * u + v * v) AS ws, (x - ex) * cos(atan2(v, u)) + (y - ey) * sin(atan2(v, u)) AS al, -(x - ex) * sin(atan2(v, u)) + (y - ey) * cos(atan2(v, u)) AS ac FROM snd, emi)) GROUP BY 1),
  pd AS (SELECT s.*, mass / 44.0095e-3 / (95000e0 / (9.80665e0 * 28.9644e-3)) * 1e6 AS pred, 1 / (unc * unc) AS w FROM snd s JOIN pr USING (event_id))"""


def soundings(spark, sf):
    """View events as soundings with the day's wind, and supplier emitters around the source."""
    o = v.observations(spark, sf, "view").join(v.winds(spark, sf).select("overpass", "u", "v"), "overpass")
    s = o.select("event_id", F.col("overpass").alias("day"), geo.offset_east_km("lon", F.lit(v.SOURCE[0]), F.lit(v.SOURCE[1])).alias("x"),
                 geo.offset_north_km("lat", F.lit(v.SOURCE[0])).alias("y"), F.col("value").alias("xco2"), (1 + F.col("cloud")).alias("unc"), "u", "v", F.lit(95000.0).alias("psurf"))
    k = F.col("s_suppkey")
    em = v.table(spark, sf, "supplier").select((k * 3 % 21 - 10.0).alias("x"), (k * 7 % 17 - 8.0).alias("y"), (F.greatest("s_acctbal", F.lit(0.0)) / 10).alias("rate"))
    return regression.predicted_enhancement(s, em, ["event_id"])


@query(f"WITH {v.OBS}, {v.WIND}, {_SND} SELECT event_id, round(pred, 3) AS pred_ppm FROM pd")
def plume_prediction(spark, sf):
    """Gaussian column-plume enhancement of every sounding from all upwind emitters."""
    return soundings(spark, sf).select("event_id", F.round("pred_ppm", 3).alias("pred_ppm"))


_FWL = """r1 AS (SELECT *, x - sum(w * x) OVER k / sum(w) OVER k AS xr, y - sum(w * y) OVER k / sum(w) OVER k AS y1, pred - sum(w * pred) OVER k / sum(w) OVER k AS p1, xco2 - sum(w * xco2) OVER k / sum(w) OVER k AS t1, count(*) OVER k AS n FROM pd WINDOW k AS (PARTITION BY day)),
  r2 AS (SELECT *, y1 - xr * sum(w * xr * y1) OVER k / sum(w * xr * xr) OVER k AS yr, p1 - xr * sum(w * xr * p1) OVER k / sum(w * xr * xr) OVER k AS p2, t1 - xr * sum(w * xr * t1) OVER k / sum(w * xr * xr) OVER k AS t2 FROM r1 WINDOW k AS (PARTITION BY day)),
  r3 AS (SELECT *, p2 - yr * sum(w * yr * p2) OVER k / sum(w * yr * yr) OVER k AS pr, t2 - yr * sum(w * yr * t2) OVER k / sum(w * yr * yr) OVER k AS t3 FROM r2 WINDOW k AS (PARTITION BY day)),
  b AS (SELECT day, any_value(n) AS n, sum(w * pr * t3) / sum(w * pr * pr) AS beta, sum(w * pr * pr) AS spp, sum(w * t3 * t3) AS stt FROM r3 GROUP BY 1),
  c AS (SELECT *, (stt - beta * beta * spp) / greatest(n - 4, 1) AS chi2 FROM b), fit AS (SELECT day, n, beta, sqrt(greatest(chi2, 1) / spp) AS se, chi2 FROM c)"""


@query(f"WITH {v.OBS}, {v.WIND}, {_SND}, {_FWL} SELECT day, n, round(beta, 6) AS beta, round(se, 6) AS beta_se, round(chi2, 4) AS chi2 FROM fit")
def plume_regression(spark, sf):
    """Per-day scaling of the predicted plume with background and gradients, by weighted normal equations."""
    f = regression.scale_plume(soundings(spark, sf), "day", "xco2", "unc")
    return f.select("day", "n", F.round("beta", 6).alias("beta"), F.round("beta_se", 6).alias("beta_se"), F.round("chi2", 4).alias("chi2"))


@query(f"""WITH {v.OBS}, {v.WIND}, {_SND}, {_FWL}, s AS (SELECT sum(1 / (se * se)) AS sw, sum(beta / (se * se)) AS sb, count(*) AS n FROM fit),
  t AS (SELECT sb / sw AS beta, 1 / sqrt(sw) AS se, n FROM s), q AS (SELECT any_value(t.beta) AS beta, any_value(t.se) AS se, sum(pow(f.beta - t.beta, 2) / (f.se * f.se)) / (any_value(t.n) - 1) AS chi FROM fit f, t)
  SELECT round(beta, 6) AS beta, round(se, 6) AS beta_se, round(chi, 4) AS between_chi2, round(se * greatest(1, sqrt(chi)), 6) AS beta_se_inflated FROM q""")
def plume_combined(spark, sf):
    """Inverse-variance mean of the daily scalings, its error inflated by the between-day spread."""
    f = regression.scale_plume(soundings(spark, sf), "day", "xco2", "unc")
    c = statistics.inverse_variance(f, "beta", "beta_se")
    return rnd(rnd(c, 6, "beta", "beta_se", "beta_se_inflated"), 4, "between_chi2")
