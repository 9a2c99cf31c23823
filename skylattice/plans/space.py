"""Projection, sampling, containment and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import geodesy as geo
from skylattice.functions.values import keep_classes, normalised_difference, pixel_km2
from skylattice.operators import covering, sampling, spatial
from skylattice.operators.folds import holdout_by_zone
from skylattice.operators.raster import densify, fill_missing, pixel_grid
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.settings import STUDY
from skylattice.sources.tables import classify, feature_rows, parse_features, ring_bounds


def r6(c):
    return F.round(c, 6)


# the corridor of the test lattice, km
PATH = [(3.0, 2.0), (12.0, 9.0), (20.0, 13.0), (31.0, 22.0), (44.0, 37.0)]
DISCS = [(10.0, 30.0, 2.5)]
BUFFER = STUDY.corridor_buffer_km


def seg_dist(px: str, py: str, a, b) -> str:
    dx, dy = b[0] - a[0], b[1] - a[1]
    l2 = dx * dx + dy * dy
    t = f"greatest(0e0, least(1e0, (({px} - {a[0]!r}) * {dx!r} + ({py} - {a[1]!r}) * {dy!r}) / {l2!r}))"
    return f"sqrt(pow({px} - ({a[0]!r} + {t} * {dx!r}), 2) + pow({py} - ({a[1]!r} + {t} * {dy!r}), 2))"


def path_dist(px: str, py: str) -> str:
    return "least(" + ", ".join(seg_dist(px, py, a, b) for a, b in zip(PATH[:-1], PATH[1:])) + ")"


def corridor_sql(px: str, py: str) -> str:
    return f"({path_dist(px, py)} <= 3.5 OR sqrt(pow({px} - 10, 2) + pow({py} - 30, 2)) <= 2.5)"


# ---------------------------------------------------------------- projection and keys
_A = [repr(a) for a in geo._ALPHA]
_ECC = repr(2 * geo._N**0.5 / (1 + geo._N))
_KA = repr(geo._K0 * geo._RECT)


@query(f"""WITH {v.CELLS}, p AS (SELECT cell_id, lat, lon, radians(lat) AS phi, radians(lon - 75) AS lam FROM cells),
  q AS (SELECT *, sinh(atanh(sin(phi)) - {_ECC} * atanh({_ECC} * sin(phi))) AS t FROM p),
  r AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM q)
  SELECT cell_id, round(500000 + {_KA} * (eta + {_A[0]} * cos(2 * xi) * sinh(2 * eta) + {_A[1]} * cos(4 * xi) * sinh(4 * eta) + {_A[2]} * cos(6 * xi) * sinh(6 * eta)), 3) AS x_utm,
    round({_KA} * (xi + {_A[0]} * sin(2 * xi) * cosh(2 * eta) + {_A[1]} * sin(4 * xi) * cosh(4 * eta) + {_A[2]} * sin(6 * xi) * cosh(6 * eta)), 3) AS y_utm,
    round(lat, 7) AS lat_back, round(lon, 7) AS lon_back FROM r""")
def utm_projection(spark, sf):
    """Cell centres to UTM metres and back."""
    x, y = geo.utm_forward("lat", "lon")
    c = v.cells(spark, sf).select("cell_id", x.alias("x"), y.alias("y"))
    lat, lon = geo.utm_inverse("x", "y")
    return c.select("cell_id", F.round("x", 3).alias("x_utm"), F.round("y", 3).alias("y_utm"), F.round(lat, 7).alias("lat_back"), F.round(lon, 7).alias("lon_back"))


@query(f"""WITH {v.CELLS} SELECT cell_id, printf('c%03d_%03d', cy, cx) AS cell_name, printf('g%04d_%05d', CAST(floor(x * 1000 / 1000) AS BIGINT), CAST(floor(y * 1000 / 1000) AS BIGINT)) AS region_name,
  CAST(floor(x / 7) AS BIGINT) || '_' || CAST(floor(y / 7) AS BIGINT) AS block, CASE WHEN x >= 5 AND x < 45 THEN CAST(floor((x - 5) / 4) AS INTEGER) END AS bin FROM cells""")
def grid_snap_ids(spark, sf):
    """Lattice snapping, cell / region / block names and half-open bins."""
    return v.cells(spark, sf).select("cell_id", geo.cell_name("cy", "cx").alias("cell_name"), geo.region_cell_name(F.col("x") * 1000, F.col("y") * 1000).alias("region_name"),
                                     geo.block_name("x", "y", 7).alias("block"), geo.bin_index("x", 5.0, 4.0, 10).alias("bin"))


@query(f"""WITH {v.CUBE}, {v.PIX} SELECT p.iy, p.ix, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon, count(c.value) AS n FROM pix p LEFT JOIN cube c ON p.iy = c.iy AND p.ix = c.ix GROUP BY ALL""")
def dense_pixel_grid(spark, sf):
    """Every pixel centre of the grid with its number of valid observations."""
    n = v.screened(spark, sf).groupBy("iy", "ix").agg(F.count("value").alias("n"))
    return (pixel_grid(spark, v.grid(spark, sf)).join(n, ["iy", "ix"], "left").fillna(0, ["n"])
            .select("iy", "ix", r6("lat").alias("lat"), r6("lon").alias("lon"), "n"))


@query(f"""WITH {v.OBS} SELECT product, count(CASE WHEN lat BETWEEN 18.85e0 - 1e-2 AND 18.95e0 + 1e-2 AND lon BETWEEN 73.45e0 - 1e-2 AND 73.6e0 + 1e-2 THEN 1 END) AS n_box,
  count(CASE WHEN sqrt(pow((lon - 73.54e0) * 111.32e0 * cos(radians(18.9e0)), 2) + pow((lat - 18.9e0) * 110.574e0, 2)) <= 9 THEN 1 END) AS n_radius FROM obs GROUP BY product""")
def box_and_radius(spark, sf):
    """Padded closed box and closed radius filters."""
    o = v.observations(spark, sf)
    return o.groupBy("product").agg(F.count_if(geo.in_box("lat", "lon", (18.85, 18.95, 73.45, 73.6), 0.01)).alias("n_box"),
                                    F.count_if(geo.within_radius("lat", "lon", F.lit(v.SOURCE[0]), F.lit(v.SOURCE[1]), F.lit(9))).alias("n_radius"))


@query(f"""WITH {v.CELLS} SELECT klass, round(avg((brand - size) / nullif(brand + size, 0)), 6) AS ndi, round(avg(CASE WHEN CAST(size AS INTEGER) % 12 IN (4, 5, 6, 7) THEN label END), 6) AS kept,
  round(sum(1e-1 * 110.574e0 * 1e-1 * 111.32e0 * cos(radians(lat))), 4) AS km2 FROM cells GROUP BY 1""")
def index_and_area(spark, sf):
    """Normalised difference, class keep list, pixel area."""
    return v.cells(spark, sf).groupBy("klass").agg(
        r6(F.avg(normalised_difference("brand", "size"))).alias("ndi"), r6(F.avg(keep_classes("label", F.col("size").cast("int") % 12))).alias("kept"),
        F.round(F.sum(pixel_km2("lat", 0.1)), 4).alias("km2"))


# ---------------------------------------------------------------- nearest
@query(f"""WITH {v.CELLS}, {v.WAY} SELECT cell_id, wp, cluster, round(sqrt(d2), 6) AS dist FROM (SELECT cell_id, wp, cluster, (x - wp_x) * (x - wp_x) + (y - wp_y) * (y - wp_y) AS d2,
  row_number() OVER (PARTITION BY cell_id ORDER BY (x - wp_x) * (x - wp_x) + (y - wp_y) * (y - wp_y), wp) AS rn FROM cells, way) WHERE rn = 1""")
def nearest_waypoint(spark, sf):
    """Nearest waypoint of each cell; ties go to the first in the list."""
    n = spatial.nearest_point(v.cells(spark, sf), v.waypoints(spark, sf), "x", "y", "wp_x", "wp_y", ["wp", "cluster"], order="wp")
    return n.select("cell_id", "wp", "cluster", r6("nearest_dist").alias("dist"))


_SITES = "sites AS (SELECT s_suppkey, s_suppkey * 37 % 997 / 2e1 AS sx, s_suppkey * 59 % 883 / 2e1 AS sy FROM supplier)"
_CUST = "cust AS (SELECT c_custkey, c_custkey * 7919 % 1009 / 2e1 AS x, c_custkey * 104729 % 907 / 2e1 AS y FROM customer)"


def sites(spark, sf):
    k = F.col("s_suppkey")
    return v.table(spark, sf, "supplier").select("s_suppkey", (k * 37 % 997 / 20.0).alias("sx"), (k * 59 % 883 / 20.0).alias("sy"), "s_acctbal")


def customers(spark, sf):
    k = F.col("c_custkey")
    return v.table(spark, sf, "customer").select("c_custkey", (k * 7919 % 1009 / 20.0).alias("x"), (k * 104729 % 907 / 20.0).alias("y"))


@query(f"""WITH {_SITES}, {_CUST} SELECT c_custkey, round(min(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))), 6) AS dist,
  min_by(s_suppkey, ((x - sx) * (x - sx) + (y - sy) * (y - sy), s_suppkey)) AS site FROM cust, sites GROUP BY 1""")
def nearest_site_binned(spark, sf):
    """Nearest member of a large point set, searched through a tree of bins."""
    n = spatial.nearest_point(customers(spark, sf), sites(spark, sf), "x", "y", "sx", "sy", ["s_suppkey"], order="s_suppkey")
    return n.select("c_custkey", r6("nearest_dist").alias("dist"), F.col("s_suppkey").alias("site"))


@query(f"""WITH {v.CELLS}, z AS (SELECT x AS zx, y AS zy FROM cells WHERE brand = 7 AND size < 20),
  d AS (SELECT cell_id, any_value(brand = 7 AND size < 20) AS t, min(sqrt((x - zx) * (x - zx) + (y - zy) * (y - zy))) AS m FROM cells, z GROUP BY 1)
  SELECT cell_id, CASE WHEN t THEN 'test' WHEN m > 2 THEN 'train' ELSE 'gap' END AS split, round(m, 6) AS split_dist FROM d""")
def holdout_splits(spark, sf):
    """Zone hold-out with a buffer: test, gap and train cells."""
    h = holdout_by_zone(v.cells(spark, sf), (F.col("brand") == 7) & (F.col("size") < 20), 2.0)
    return h.select("cell_id", "split", r6("split_dist").alias("split_dist"))


# ---------------------------------------------------------------- sampling
_FILLED = f"""{v.CUBE}, {v.PIX}, pm AS (SELECT iy, ix, avg(value) AS m FROM cube GROUP BY ALL), mm AS (SELECT avg(m) AS g FROM pm),
  f AS (SELECT p.iy, p.ix, coalesce(pm.m, mm.g) AS z, pm.m AS raw FROM pix p CROSS JOIN mm LEFT JOIN pm ON p.iy = pm.iy AND p.ix = pm.ix)"""


def filled_mean(spark, sf):
    """Dense pixel means, gaps filled by the mean of the map; `raw` keeps the gaps."""
    m = v.screened(spark, sf).groupBy("iy", "ix").agg(F.avg("value").alias("z")).withColumn("raw", F.col("z"))
    return fill_missing(densify(m, v.grid(spark, sf), [], ["z", "raw"]), "z", "mean")


@query(f"""WITH {_FILLED}, {v.CELLS}, n AS (SELECT max(iy) + 1 AS nr FROM pix), c AS (SELECT cell_id, (19e0 - lat) / 2e-2 AS gy, (lon - 73.4e0) / 2e-2 AS gx, nr FROM cells, n),
  k AS (SELECT *, CAST(least(floor(gy), nr - 2) AS INTEGER) AS j, CAST(least(floor(gx), 13) AS INTEGER) AS i, gy >= 0 AND gy <= nr - 1 AND gx >= 0 AND gx <= 14 AS inside FROM c)
  SELECT cell_id, round(CASE WHEN inside THEN (1 - (gy - j)) * (1 - (gx - i)) * a.z + (1 - (gy - j)) * (gx - i) * b.z + (gy - j) * (1 - (gx - i)) * c_.z + (gy - j) * (gx - i) * d.z END, 6) AS sampled
  FROM k LEFT JOIN f a ON a.iy = j AND a.ix = i LEFT JOIN f b ON b.iy = j AND b.ix = i + 1 LEFT JOIN f c_ ON c_.iy = j + 1 AND c_.ix = i LEFT JOIN f d ON d.iy = j + 1 AND d.ix = i + 1""")
def bilinear_sample(spark, sf):
    """Bilinear value of the filled mean map at each cell centre; NULL outside the hull."""
    s = sampling.bilinear_sample(v.cells(spark, sf), filled_mean(spark, sf), v.grid(spark, sf), "z", ["cell_id"])
    return s.withColumn("sampled", r6("sampled"))


@query(f"""WITH {v.CUBE}, {v.PIX}, {v.CELLS}, n AS (SELECT max(iy) + 1 AS nr FROM pix), c AS (SELECT iy, ix, count(value) AS n FROM cube GROUP BY ALL)
  SELECT cell_id, coalesce(c.n, 0) AS n FROM cells CROSS JOIN n
  LEFT JOIN c ON c.iy = greatest(0, least(nr - 1, round_even((19e0 - lat) / 2e-2, 0))) AND c.ix = greatest(0, least(14, round_even((lon - 73.4e0) / 2e-2, 0)))""")
def nearest_sample(spark, sf):
    """Valid count of the nearest pixel of each cell."""
    n = v.screened(spark, sf).groupBy("iy", "ix").agg(F.count("value").alias("n"))
    return sampling.nearest_sample(v.cells(spark, sf), n, v.grid(spark, sf), ["n"]).select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {v.CUBE}, {v.CELLS}, p AS (SELECT CAST(floor((lon - 73.39e0) / 6.1e-3) AS BIGINT) AS cx, CAST(floor((18.99e0 - lat) / 4.7e-3) AS BIGINT) AS cy, value FROM cube),
  m AS (SELECT cx, cy, avg(value) AS z, count(value) AS n FROM p GROUP BY ALL) SELECT cx, cy, round(z, 6) AS zonal, coalesce(n, 0) AS n_pixels FROM cells LEFT JOIN m USING (cx, cy)""")
def zonal_mean(spark, sf):
    """Mean of the pixels falling into each cell; empty cells stay with NULL."""
    p = v.screened(spark, sf).select(geo.grid_index(F.col("lon") - 73.39, 0.0061).alias("cx"), geo.grid_index(F.lit(18.99) - F.col("lat"), 0.0047).alias("cy"), "value")
    return sampling.zonal_mean(p, v.cells(spark, sf), ["cx", "cy"], "value").withColumn("zonal", r6("zonal"))


# ---------------------------------------------------------------- lines and polygons
_LINES = """lines AS (SELECT o_orderkey, o_orderpriority, o_orderkey * 7919 % 1000 / 2e1 AS ax, o_orderkey * 104729 % 800 / 2e1 AS ay,
   (o_custkey % 41 - 20) / 1e1 AS ux, (o_custkey % 31 - 15) / 1e1 AS uy, (o_orderkey % 23 - 11) / 5e0 AS vx, (o_custkey % 5 - 2) * 1e0 AS vy FROM orders)"""
_CLASS = {"1-URGENT": "major", "2-HIGH": "major", "3-MEDIUM": "mid", "5-LOW": "minor"}


def lines(spark, sf):
    """One three-vertex line per order."""
    o, k, c = v.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    ax, ay = k * 7919 % 1000 / 20.0, k * 104729 % 800 / 20.0
    ux, uy, wx, wy = (c % 41 - 20) / 10.0, (c % 31 - 15) / 10.0, (k % 23 - 11) / 5.0, (c % 5 - 2) * 1.0
    pts = F.array(F.struct(ax.alias("x"), ay.alias("y")), F.struct((ax + ux).alias("x"), (ay + uy).alias("y")),
                  F.struct((ax + ux + wx).alias("x"), (ay + uy + wy).alias("y")))
    return o.select("o_orderkey", "o_orderpriority", pts.alias("pts"))


def _clip(lo: str, hi: str, p: str, q: str):
    d = f"({q} - {p})"
    e = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} >= {lo} AND {p} <= {hi} THEN -1e300 ELSE 1e300 END ELSE least(({lo} - {p}) / nullif({d}, 0), ({hi} - {p}) / nullif({d}, 0)) END"
    x = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} >= {lo} AND {p} <= {hi} THEN 1e300 ELSE -1e300 END ELSE greatest(({lo} - {p}) / nullif({d}, 0), ({hi} - {p}) / nullif({d}, 0)) END"
    return e, x


_EX, _LX = _clip("cx", "cx + 1", "x1", "x2")
_EY, _LY = _clip("cy", "cy + 1", "y1", "y2")


@query(f"""WITH {_LINES}, {v.CELLS}, k AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'major' WHEN '2-HIGH' THEN 'major' WHEN '3-MEDIUM' THEN 'mid' WHEN '5-LOW' THEN 'minor' END AS kl FROM lines),
  seg AS (SELECT kl, ax AS x1, ay AS y1, ax + ux AS x2, ay + uy AS y2 FROM k WHERE kl IS NOT NULL UNION ALL SELECT kl, ax + ux, ay + uy, ax + ux + vx, ay + uy + vy FROM k WHERE kl IS NOT NULL),
  cand AS (SELECT kl, x1, y1, x2, y2, unnest(generate_series(CAST(ceil(least(x1, x2)) AS BIGINT) - 1, CAST(floor(greatest(x1, x2)) AS BIGINT))) AS cx,
      CAST(ceil(least(y1, y2)) AS BIGINT) - 1 AS ya, CAST(floor(greatest(y1, y2)) AS BIGINT) AS yb FROM seg),
  c2 AS (SELECT kl, x1, y1, x2, y2, cx, unnest(generate_series(ya, yb)) AS cy FROM cand),
  t AS (SELECT kl, cx, cy, greatest(0e0, {_EX}, {_EY}) AS t0, least(1e0, {_LX}, {_LY}) AS t1, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM c2),
  s AS (SELECT cx, cy, kl, sum(CASE WHEN t1 > t0 THEN (t1 - t0) * len ELSE 0 END) AS km FROM t GROUP BY ALL)
  SELECT cell_id, round(coalesce(sum(CASE WHEN kl = 'major' THEN km END), 0), 6) AS major_km, round(coalesce(sum(CASE WHEN kl = 'mid' THEN km END), 0), 6) AS mid_km,
    round(coalesce(sum(CASE WHEN kl = 'minor' THEN km END), 0), 6) AS minor_km, round(coalesce(sum(km), 0), 6) AS total_km FROM cells LEFT JOIN s USING (cx, cy) GROUP BY 1""")
def line_in_cell_km(spark, sf):
    """Kilometres of classed lines inside every cell."""
    seg = spatial.line_segments(classify(lines(spark, sf), "o_orderpriority", _CLASS), "pts", ["klass"])
    k = spatial.line_km_per_cell(seg, v.cells(spark, sf), 1.0, ["major", "mid", "minor"])
    return k.select("cell_id", *[r6(c).alias(c) for c in ("major_km", "mid_km", "minor_km", "total_km")])


_DIAMOND = """poly AS (SELECT s_suppkey, s_suppkey * 37 % 997 / 2e1 AS sx, s_suppkey * 59 % 883 / 2e1 AS sy, 1 + s_suppkey % 7 / 2e0 AS rx, 1 + s_suppkey % 5 / 2e0 AS ry FROM supplier)"""


def _diamond(scale, east):
    k = F.col("s_suppkey")
    rx, ry = (1 + k % 7 / 2.0) * scale, (1 + k % 5 / 2.0) * scale
    x, y = F.col("sx") + east, F.col("sy")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(p(x + rx, y), p(x, y + ry), p(x - rx, y), p(x, y - ry))


def diamonds(spark, sf):
    """One four-vertex polygon per supplier."""
    return sites(spark, sf).select("s_suppkey", _diamond(1.0, 0.0).alias("ring"))


# even-odd crossing count of the four diamond edges
def _inside(px: str, py: str, scale: str = "1e0", east: str = "0e0") -> str:
    x, rx, ry = f"(sx + {east})", f"(rx * {scale})", f"(ry * {scale})"
    v_ = [(f"{x} + {rx}", "sy"), (x, f"sy + {ry}"), (f"{x} - {rx}", "sy"), (x, f"sy - {ry}")]
    parts = []
    for (x1, y1), (x2, y2) in zip(v_, v_[1:] + v_[:1]):
        parts.append(f"CASE WHEN (({y1}) > {py}) <> (({y2}) > {py}) AND {px} < (({x2}) - ({x1})) * ({py} - ({y1})) / nullif(({y2}) - ({y1}), 0) + ({x1}) THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(f"""WITH {_DIAMOND}, {v.CELLS}, sp AS (SELECT (k % 5 + 5e-1) / 5 AS dx, (k // 5 + 5e-1) / 5 AS dy FROM (SELECT unnest(range(25)) AS k)),
  pts AS (SELECT cell_id, cx + dx AS px, cy + dy AS py FROM cells, sp),
  hit AS (SELECT DISTINCT cell_id, px, py FROM pts JOIN poly ON px BETWEEN sx - rx AND sx + rx AND py BETWEEN sy - ry AND sy + ry WHERE {_inside('px', 'py')})
  SELECT cell_id, round(count(px) / 25e0, 6) AS cover FROM cells LEFT JOIN hit USING (cell_id) GROUP BY 1""")
def polygon_cover_fraction(spark, sf):
    """Share of each cell under the union of all polygons, overlaps counted once."""
    rings = diamonds(spark, sf).select(F.array("ring").alias("rings"))
    return covering.covered_share(rings, "rings", v.cells(spark, sf), 1.0, 5).withColumn("cover", r6("cover"))


@query(f"WITH {_DIAMOND}, {_CUST} SELECT c_custkey, s_suppkey FROM cust JOIN poly ON x BETWEEN sx - rx AND sx + rx AND y BETWEEN sy - ry AND sy + ry WHERE {_inside('x', 'y')}")
def points_in_polygons(spark, sf):
    """Containment join of points and polygons (even-odd rule), overlapping polygons allowed."""
    areas = diamonds(spark, sf).select("s_suppkey", F.array("ring").alias("rings"))
    return covering.points_in_areas(customers(spark, sf), areas, "rings", 1.0, ["c_custkey"], ["s_suppkey"])


def multi_diamonds(spark, sf):
    """Two-part polygons: every supplier's diamond with a hole of half its size, and the same diamond 10 km to the east."""
    return sites(spark, sf).select("s_suppkey", F.array(_diamond(1.0, 0.0), _diamond(0.5, 0.0), _diamond(1.0, 10.0)).alias("rings"))


@query(f"WITH {_DIAMOND}, {_CUST} SELECT c_custkey, s_suppkey FROM cust JOIN poly ON x BETWEEN sx - rx AND sx + rx + 10 AND y BETWEEN sy - ry AND sy + ry WHERE ({_inside('x', 'y')}) <> ({_inside('x', 'y', '5e-1')}) OR {_inside('x', 'y', east='10e0')}")
def points_in_multipolygons(spark, sf):
    """Containment join of points and areas of two parts, one with a hole."""
    return covering.points_in_areas(customers(spark, sf), multi_diamonds(spark, sf), "rings", 1.0, ["c_custkey"], ["s_suppkey"])


@query(f"""WITH {_LINES}, {_DIAMOND} SELECT 'lines' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM (SELECT o_orderkey AS id FROM lines WHERE
    (ax BETWEEN 10 AND 20 AND ay BETWEEN 10 AND 18) OR (ax + ux BETWEEN 10 AND 20 AND ay + uy BETWEEN 10 AND 18) OR (ax + ux + vx BETWEEN 10 AND 20 AND ay + uy + vy BETWEEN 10 AND 18))
  UNION ALL SELECT 'polygons', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM poly WHERE greatest(10 - sx, 0e0, sx - 20) / rx + greatest(10 - sy, 0e0, sy - 18) / ry <= 1""")
def geometry_box_filters(spark, sf):
    """Lines with a vertex in a box, and polygons meeting it."""
    a = lines(spark, sf).where(spatial.any_vertex_in_box("pts", 10.0, 20.0, 10.0, 18.0)).agg(F.lit("lines").alias("kind"), F.count("*").alias("n"), F.sum("o_orderkey").alias("id_sum"))
    b = diamonds(spark, sf).where(spatial.polygon_meets_box("ring", 10.0, 20.0, 10.0, 18.0)).agg(F.lit("polygons").alias("kind"), F.count("*").alias("n"), F.sum("s_suppkey").alias("id_sum"))
    return a.unionByName(b)


@query(f"WITH {_DIAMOND} SELECT count(*) AS n, round(min(sx - rx), 6) AS x_min, round(max(sx + rx), 6) AS x_max, round(min(sy - ry), 6) AS y_min, round(max(sy + ry), 6) AS y_max FROM poly")
def feature_collection_roundtrip(spark, sf):
    """Polygons written as JSON features, parsed back, and bounded over all rings."""
    feats = feature_rows(diamonds(spark, sf), "s_suppkey", "ring")
    docs = feats.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "feature", F.lit("]}")).alias("text"))
    back = parse_features(docs, "text", "s_suppkey")
    b = ring_bounds(back, "ring").withColumn("k", F.lit(0))
    n = back.agg(F.count_distinct("s_suppkey").alias("n")).withColumn("k", F.lit(0))
    return n.join(b, "k").select("n", *[r6(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


# ---------------------------------------------------------------- corridor and zones
@query(f"WITH {v.CELLS} SELECT cell_id, round({path_dist('x', 'y')}, 6) AS path_km, {corridor_sql('x', 'y')} AS inside FROM cells")
def corridor_membership(spark, sf):
    """Exact distance to the corridor's centreline, and membership including the extra discs."""
    return v.cells(spark, sf).select("cell_id", r6(geo.distance_to_path("x", "y", PATH)).alias("path_km"), geo.in_corridor("x", "y", PATH, BUFFER, DISCS).alias("inside"))


@query(f"""WITH {v.CELLS}, sp AS (SELECT (k % 10 + 5e-1) / 10 AS dx, (k // 10 + 5e-1) / 10 AS dy FROM (SELECT unnest(range(100)) AS k)),
  fr AS (SELECT cx, cy, avg(CASE WHEN {corridor_sql('(cx + dx)', '(cy + dy)')} THEN 1e0 ELSE 0e0 END) AS f FROM cells, sp GROUP BY ALL)
  SELECT cx, cy, f >= 5e-1 AS in_corridor, round(CASE WHEN f >= 5e-1 THEN f ELSE 0 END, 6) AS frac_in_corridor, round(sqrt((x - 25) * (x - 25) + (y - 20) * (y - 20)), 6) AS dist_to_source
  FROM cells JOIN fr USING (cx, cy) WHERE f >= 5e-1 OR (sqrt((x - 25) * (x - 25) + (y - 20) * (y - 20)) <= 18 AND x BETWEEN 5 AND 45 AND y BETWEEN 5 AND 1000)""")
def region_grid(spark, sf):
    """Training grid: cells near the source inside the shrunk box, plus every corridor cell with its area share."""
    lat = v.cells(spark, sf).select("cx", "cy", "x", "y")
    cor = spatial.corridor_cells(lat, 1.0, PATH, BUFFER, DISCS)
    g = spatial.region_cells(lat, cor, (25.0, 20.0), 18.0, (0.0, 50.0, 0.0, 1005.0), 5.0)
    return g.select("cx", "cy", "in_corridor", r6("frac_in_corridor").alias("frac_in_corridor"), r6("dist_to_source").alias("dist_to_source"))


@query(f"""WITH {v.CELLS}, {v.WAY}, n AS (SELECT cell_id, cluster FROM (SELECT cell_id, cluster, row_number() OVER (PARTITION BY cell_id ORDER BY (x - wp_x) * (x - wp_x) + (y - wp_y) * (y - wp_y), wp) AS rn FROM cells, way) WHERE rn = 1),
  c AS (SELECT label, cluster, {corridor_sql('x', 'y')} AS cor, sqrt((x - 25) * (x - 25) + (y - 20) * (y - 20)) AS r FROM cells JOIN n USING (cell_id)),
  z AS (SELECT cluster AS zone, label FROM c WHERE cor UNION ALL SELECT 'corridor', label FROM c WHERE cor UNION ALL SELECT 'core', label FROM c WHERE NOT cor AND r <= 10
    UNION ALL SELECT 'r' || CAST(k AS VARCHAR) || 'km', label FROM c, (SELECT unnest([5, 10, 15, 20, 25, 30, 35]) AS k) WHERE r <= k)
  SELECT zone, round(sum(label), 4) AS total FROM z GROUP BY 1""")
def zone_totals_multi(spark, sf):
    """Overlapping zones in one pass: clusters partition the corridor, the core is its complement near the source, seven radii."""
    c = spatial.nearest_point(v.cells(spark, sf), v.waypoints(spark, sf), "x", "y", "wp_x", "wp_y", ["cluster"], order="wp")
    cor = geo.in_corridor("x", "y", PATH, BUFFER, DISCS)
    r = F.sqrt((F.col("x") - 25) * (F.col("x") - 25) + (F.col("y") - 20) * (F.col("y") - 20))
    zones = {"corridor": cor, "core": ~cor & (r <= 10), **{f"r{k}km": r <= k for k in (5, 10, 15, 20, 25, 30, 35)}}
    return spatial.zone_totals(c, zones, F.col("label"), names=[F.when(cor, F.col("cluster"))]).withColumn("total", F.round("total", 4))
