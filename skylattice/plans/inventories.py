"""Inventory totals and ratios, temporal factor, feature assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import calendar as cal
from skylattice.functions import geodesy as geo
from skylattice.operators import features, inventory, temporal_factor
from skylattice.operators.labels import zone_season_totals
from skylattice.operators.sizing import join_on
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.sources.tables import read_inventory


def rnd(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


_OFF = "sp AS (SELECT (k % 10 + 5e-1) / 10 - 5e-1 AS a, (k // 10 + 5e-1) / 10 - 5e-1 AS b FROM (SELECT unnest(range(100)) AS k))"
_CIRCLE = "sqrt(pow((({lon}) - 73.54e0) * 111.32e0 * cos(radians(18.9e0)), 2) + pow((({lat}) - 18.9e0) * 110.574e0, 2)) <= 25"
_FRAC = f"""{_OFF}, gc AS (SELECT DISTINCT lat, lon FROM inv), fr AS (SELECT lat, lon, avg(CASE WHEN {_CIRCLE.format(lat='lat + a * 1e-1', lon='lon + b * 1e-1')} THEN 1e0 ELSE 0e0 END) AS f FROM gc, sp GROUP BY ALL),
  tt AS (SELECT species, year, sector, sum(value * f) AS total FROM inv JOIN fr USING (lat, lon) GROUP BY ALL)"""


def in_city(lat, lon):
    return geo.within_radius(lat, lon, F.lit(v.SOURCE[0]), F.lit(v.SOURCE[1]), F.lit(25.0))


def city_totals(spark, sf, keys=("species", "year", "sector")):
    return inventory.region_totals(v.inventory(spark, sf), 0.1, in_city, list(keys))


@query(f"WITH {v.INV} SELECT species, year, sector, count(*) AS n, round(sum(CASE WHEN value > 1 THEN value END), 2) AS total FROM inv WHERE lat > 18.65e0 AND lat < 19.05e0 AND lon > 73.25e0 AND lon < 73.75e0 GROUP BY ALL")
def inventory_scan(spark, sf):
    """Open-box clip of the inventory with sentinel values set to missing."""
    from skylattice.functions.values import missing_if_sentinel

    i = read_inventory(v.inventory(spark, sf), (18.65, 19.05, 73.25, 73.75))
    return i.groupBy("species", "year", "sector").agg(F.count("*").alias("n"), F.round(F.sum(missing_if_sentinel("value", 1.0)), 2).alias("total"))


@query(f"WITH {v.INV}, {_FRAC} SELECT species, year, sector, round(total, 6) AS total FROM tt")
def region_totals(spark, sf):
    """Area-weighted totals within the circle per species, year and sector."""
    return rnd(city_totals(spark, sf), 6, "total")  # beyond the five decimals of the exact sums, where no tie can occur


_SEC = """sc AS (SELECT sector, sum(CASE WHEN species = 'NOx' THEN total END) AS den, sum(CASE WHEN species = 'CO2' THEN total END) AS num, sum(CASE WHEN species = 'CO' THEN total END) AS tracer FROM tt GROUP BY 1),
  s1 AS (SELECT *, CASE WHEN den > 1 THEN num / den END AS ratio, CASE WHEN den > 1 THEN tracer / den END AS tr FROM sc WHERE den > 1 OR num > 100)"""


def sectors(spark, sf):
    return inventory.sector_table(city_totals(spark, sf, ("species", "sector")), "CO2", "NOx", "CO")


@query(f"WITH {v.INV}, {_FRAC}, {_SEC} SELECT sector, round(den, 4) AS den, round(num, 2) AS num, round(tracer, 4) AS tracer, round(ratio, 6) AS ratio, round(tr, 6) AS tracer_ratio FROM s1")
def sector_ratio(spark, sf):
    """Guarded sector ratios; sectors negligible in both species are left out."""
    s = sectors(spark, sf)
    return rnd(rnd(rnd(s, 4, "den", "tracer"), 2, "num"), 6, "ratio", "tracer_ratio")


@query(f"""WITH {v.INV}, {_FRAC}, {_SEC}, y AS (SELECT year, sum(CASE WHEN species = 'CO2' THEN total END) / sum(CASE WHEN species = 'NOx' THEN total END) AS r FROM tt GROUP BY 1),
  a AS (SELECT sum(num) / (sum(den) - sum(CASE WHEN sector IN ('PROMO', 'SMALL') THEN den END)) AS adj FROM s1)
  SELECT round(avg(r), 6) AS mean_ratio, round(stddev_pop(r), 6) AS sd_ratio, round(stddev_pop(r) / avg(r), 6) AS rel_sd, round(any_value(adj), 6) AS adjusted_ratio FROM y, a""")
def ratio_over_years(spark, sf):
    """Mean and spread of the annual ratio, and the ratio without sectors lacking a counterpart."""
    t = city_totals(spark, sf)
    s = inventory.ratio_spread(inventory.annual_ratios(t, "CO2", "NOx")).withColumn("k", F.lit(0))
    sec = inventory.sector_table(t.groupBy("species", "sector").agg(F.sum("total").alias("total")), "CO2", "NOx", "CO")
    a = inventory.adjusted_ratio(sec, ["PROMO", "SMALL"]).withColumn("k", F.lit(0))
    return rnd(s.join(F.broadcast(a), "k").drop("k"), 6, "mean_ratio", "sd_ratio", "rel_sd", "adjusted_ratio")


_OBS_RATIO = 1.79


@query(f"""WITH {v.INV}, {_FRAC}, {_SEC}, a AS (SELECT *, sum(tracer) OVER () / sum(den) OVER () AS r_all FROM s1), h AS (SELECT *, coalesce(den > 100 AND tr > r_all, false) AS hi FROM a),
  g AS (SELECT sum(CASE WHEN hi THEN tracer END) / sum(CASE WHEN hi THEN den END) AS th, sum(CASE WHEN NOT hi THEN tracer END) / sum(CASE WHEN NOT hi THEN den END) AS tl,
    sum(CASE WHEN hi THEN num END) / sum(CASE WHEN hi THEN den END) AS qh, sum(CASE WHEN NOT hi THEN num END) / sum(CASE WHEN NOT hi THEN den END) AS ql, sum(CASE WHEN hi THEN den END) / sum(den) AS sh FROM h),
  m AS (SELECT *, ({_OBS_RATIO}e0 - tl) / nullif(th - tl, 0) AS al FROM g)
  SELECT round(th, 6) AS t_high, round(tl, 6) AS t_low, round(qh, 4) AS q_high, round(ql, 4) AS q_low, round(sh, 6) AS inventory_share_high, round(al, 4) AS alpha, round(greatest(0, least(1, al)), 4) AS share_high,
    round(greatest(0, least(1, al)) * qh + (1 - greatest(0, least(1, al))) * ql, 4) AS mixed_ratio FROM m""")
def sector_mixing(spark, sf):
    """Two sector groups mixed so that an observed tracer ratio is met; clipped share and implied ratio."""
    m = inventory.two_group_mix(sectors(spark, sf), _OBS_RATIO)
    return rnd(rnd(m, 6, "t_high", "t_low", "inventory_share_high"), 4, "q_high", "q_low", "alpha", "share_high", "mixed_ratio")


_SPLIT = f"""WITH {v.INV}, {_FRAC}, {_SEC}, s AS (SELECT sector, den / sum(den) OVER () AS sh, coalesce(tr, 0) AS cr, num / den AS q FROM s1 WHERE den > 1),
  p AS (SELECT * FROM (VALUES ('LARGE', 'SMALL'), ('PROMO', 'ECONOMY')) x(a, b), (VALUES (1.78e0), (1.8e0)) y(target)),
  c AS (SELECT p.a, p.b, p.target, sa.sh + sb.sh AS pool, sa.sh AS sha, sa.cr AS ca, sb.cr AS cb, sa.q AS qa, sb.q AS qb, (SELECT sum(sh * cr) FROM s WHERE sector NOT IN (p.a, p.b)) AS fc, (SELECT sum(sh * q) FROM s WHERE sector NOT IN (p.a, p.b)) AS fq
    FROM p JOIN s sa ON sa.sector = p.a JOIN s sb ON sb.sector = p.b), d AS (SELECT *, ((target - fc) / pool - cb) / nullif(ca - cb, 0) AS f FROM c)"""


@query(f"""{_SPLIT}
  SELECT a, b, target, round(f, 3) AS fraction_a, f BETWEEN 0 AND 1 AS feasible, round(sha / pool, 6) AS inventory_fraction_a, round(fq + pool * (greatest(0, least(1, f)) * qa + (1 - greatest(0, least(1, f))) * qb), 4) AS ratio FROM d""")
def pair_resplit(spark, sf):
    """Scenario table of re-split sector pairs with feasibility."""
    p = inventory.pair_resplit(sectors(spark, sf), [("LARGE", "SMALL"), ("PROMO", "ECONOMY")], [1.78, 1.8])
    return rnd(rnd(rnd(p, 3, "fraction_a"), 6, "inventory_fraction_a"), 4, "ratio")


@query(f"""{_SPLIT}, x AS (SELECT f, fq + pool * (f * qa + (1 - f) * qb) AS ratio FROM d WHERE f BETWEEN 0 AND 1)
  SELECT round(min(ratio), 4) AS ratio_lo, round(max(ratio), 4) AS ratio_hi, round(avg(ratio), 4) AS ratio_mean, count(*) AS n_feasible FROM x""")
def feasible_ratio_range(spark, sf):
    """Range and mean of the ratio over all feasible re-splits, pooled over pairs and targets."""
    p = inventory.pair_resplit(sectors(spark, sf), [("LARGE", "SMALL"), ("PROMO", "ECONOMY")], [1.78, 1.8])
    return rnd(inventory.feasible_range(p), 4, "ratio_lo", "ratio_hi", "ratio_mean")


@query(f"""WITH {v.CELLS}, z AS (SELECT klass AS zone, size, label FROM cells), t AS (SELECT zone, sum(label) AS total FROM z GROUP BY 1 UNION ALL SELECT 'city', sum(label) FROM z)
  SELECT zone, round(total, 2) AS total, round(total / (SELECT total FROM t WHERE zone = 'city'), 8) AS share, round(2.79e0 * total / (SELECT total FROM t WHERE zone = 'city'), 8) AS zone_rate FROM t""")
def zone_shares(spark, sf):
    """Zone shares of the city total and the city rate split by them."""
    from skylattice.operators.spatial import zone_totals

    c = v.cells(spark, sf)
    kinds = ("LARGE", "SMALL", "PROMO", "STANDARD", "ECONOMY", "MEDIUM")
    z = zone_totals(c, {**{k: F.col("klass") == k for k in kinds}, "city": F.lit(True)}, F.col("label"))
    s = inventory.share_of_total(z, "city", rate=2.79)
    return rnd(rnd(s, 2, "total"), 8, "share", "zone_rate")


# ---------------------------------------------------------------- temporal factor
_PROFILE = """o AS (SELECT o_orderpriority AS sector, CAST(month(o_orderdate) AS INTEGER) AS month_no, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, CAST(o_orderkey % 24 AS INTEGER) AS hour, o_totalprice AS value FROM orders),
  hp AS (SELECT sector, month_no, dow, hour, sum(value) AS value FROM o GROUP BY ALL), sw AS (SELECT sector, sum(value) / (SELECT sum(o2.value) FROM o o2) AS weight FROM o GROUP BY sector),
  wk AS (SELECT sector, dow, sv / sum(sv) OVER (PARTITION BY sector) AS factor FROM (SELECT sector, dow, sum(value) AS sv FROM o GROUP BY sector, dow)), mo AS (SELECT sector, month_no, sv / sum(sv) OVER (PARTITION BY sector) AS share FROM (SELECT sector, month_no, sum(value) AS sv FROM o GROUP BY sector, month_no)),
  ob AS (SELECT l_shipdate + INTERVAL 1 HOUR * (l_linenumber + 8) + INTERVAL 330 MINUTE AS t FROM lineitem),
  nn AS (SELECT count(*) AS n FROM ob), wh AS (SELECT hour(t) AS hour, count(*) / any_value(n) AS w FROM ob, nn GROUP BY 1), wd AS (SELECT isodow(t) - 1 AS dow, count(*) / any_value(n) AS w FROM ob, nn GROUP BY 1), wm AS (SELECT month(t) AS month_no, count(*) / any_value(n) AS w FROM ob, nn GROUP BY 1)"""


def profile_tables(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sector"), F.month("o_orderdate").alias("month_no"), F.weekday("o_orderdate").alias("dow"),
                                            (F.col("o_orderkey") % 24).cast("int").alias("hour"), F.col("o_totalprice").alias("value"))
    hourly = o.groupBy("sector", "month_no", "dow", "hour").agg(F.sum("value").alias("value"))
    total = lambda *k: hourly.groupBy(*k).agg(F.sum("value").alias("value"))
    sec = total("sector")
    from pyspark.sql import Window

    every, per = Window.partitionBy(), Window.partitionBy("sector")  # sector- and profile-sized tables
    sw = sec.select("sector", (F.col("value") / F.sum("value").over(every)).alias("weight"))
    wk = total("sector", "dow").select("sector", "dow", (F.col("value") / F.sum("value").over(per)).alias("factor"))
    mo = total("sector", "month_no").select("sector", "month_no", (F.col("value") / F.sum("value").over(per)).alias("month_share"))
    return sw, hourly, wk, mo


@query(f"""WITH {_PROFILE}, d AS (SELECT sector, month_no, dow, sum(value * coalesce(w, 0)) / sum(value) * 24 AS f FROM hp LEFT JOIN wh USING (hour) GROUP BY ALL),
  fh AS (SELECT sector, sum(wm.w * wd.w * f) AS f_hour FROM d JOIN wd USING (dow) JOIN wm USING (month_no) GROUP BY 1), fw AS (SELECT sector, sum(w * factor * 7) AS f_week FROM wk JOIN wd USING (dow) GROUP BY 1),
  fm AS (SELECT sector, sum(w * share * 12) AS f_month FROM mo JOIN wm USING (month_no) GROUP BY 1), a AS (SELECT * FROM sw JOIN fh USING (sector) JOIN fw USING (sector) JOIN fm USING (sector))
  SELECT 'profiles' AS variant, round(sum(weight * f_hour * f_week * f_month) / sum(weight), 8) AS factor FROM a
  UNION ALL SELECT 'flat months', round(sum(weight * f_hour * f_week * CASE WHEN sector = '5-LOW' THEN 1 ELSE f_month END) / sum(weight), 8) FROM a""")
def temporal_factor_F(spark, sf):
    """Observation-time rate over annual mean, with and without a flat month profile for one sector."""
    sw, hourly, wk, mo = profile_tables(spark, sf)
    ts = F.timestamp_add("HOUR", F.col("l_linenumber") + 8, F.col("l_shipdate"))
    hours, dows, months = temporal_factor.sampling_shares(v.table(spark, sf, "lineitem"), cal.local_time(ts))
    f = temporal_factor.representativeness(sw, hourly, wk, mo, hours, dows, months, flat=["5-LOW"])
    return rnd(f, 8, "factor")


@query("""WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'own' ELSE 'region' END AS owner, l_suppkey % 4 AS activity, p_type AS klass, year(l_shipdate) AS year, month(l_shipdate) AS month, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  px AS (SELECT * FROM (VALUES ('c1', 'S'), ('c1', 'ECO'), ('c2', 'PRO'), ('c2', 'ME'), ('c3', 'LARGE')) t(code, prefix)),
  m AS (SELECT DISTINCT code, owner, activity, klass, year, month, value FROM p JOIN px ON starts_with(klass, prefix) WHERE NOT (owner = 'own' AND code = 'c3')),
  b AS (SELECT *, row_number() OVER (PARTITION BY code, owner, activity, month ORDER BY year DESC, klass) AS rn, max(year) OVER (PARTITION BY code, owner, activity) AS my FROM m),
  k AS (SELECT code, owner, activity, min_by(klass, (-year, klass)) AS klass, max(year) AS year FROM m GROUP BY ALL), c AS (SELECT m.* FROM m JOIN k USING (code, owner, activity, klass, year)),
  f AS (SELECT code, owner, activity, month, value / sum(value) OVER (PARTITION BY code, owner, activity) AS f FROM c),
  g AS (SELECT code, month, avg(CASE WHEN owner = 'own' THEN f END) AS o, avg(CASE WHEN owner = 'region' THEN f END) AS r FROM f GROUP BY ALL)
  SELECT code, CAST(month AS INTEGER) AS month, round(coalesce(o, r), 8) AS month_share FROM g""")
def prefix_profiles(spark, sf):
    """Monthly profiles by class-code prefix, own rows before region rows, latest year per activity."""
    l = v.table(spark, sf, "lineitem").join(v.table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    p = l.groupBy(F.when(F.col("l_returnflag") == "R", "own").otherwise("region").alias("owner"), (F.col("l_suppkey") % 4).alias("activity"), F.col("p_type").alias("klass"),
                  F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("value"))
    p = p.where(~((F.col("owner") == "own") & F.col("klass").startswith("LARGE")))  # one class has region rows only
    px = spark.createDataFrame([("c1", "S"), ("c1", "ECO"), ("c2", "PRO"), ("c2", "ME"), ("c3", "LARGE")], "code string, prefix string")
    return rnd(temporal_factor.profile_by_prefix(p, px, ("own", "region")), 8, "month_share")


# ---------------------------------------------------------------- feature table
_FEAT = """b AS (SELECT l_partkey AS cell_id, strftime(l_shipdate, '%Y-%m') AS month, any_value(year(l_shipdate)) AS y, any_value(month(l_shipdate)) AS m, avg(l_quantity) AS no2, count(*) AS no2_n, avg(l_discount) AS hcho, avg((l_suppkey * 37 + l_linenumber * 11) % 360 * 9.871e-1) AS wd850, avg(l_tax) AS t2m FROM lineitem GROUP BY 1, 2),
  bs AS (SELECT *, CAST(y - CASE WHEN m < 10 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((y - CASE WHEN m < 10 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season FROM b)"""


def monthly_features(spark, sf):
    l = v.table(spark, sf, "lineitem")
    g = l.groupBy(F.col("l_partkey").alias("cell_id"), cal.month_key("l_shipdate").alias("month"), F.trunc(F.to_date("l_shipdate"), "month").alias("m0")).agg(
        F.avg("l_quantity").alias("no2"), F.count("*").alias("no2_n"), F.avg("l_discount").alias("hcho"),
        F.avg((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % 360 * 0.9871).alias("wd850"), F.avg("l_tax").alias("t2m"))
    return g.withColumn("season", cal.season_label("m0")).withColumn("y", F.year("m0")).drop("m0")


@query(f"""WITH {_FEAT}, {v.CELLS}, mm AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) / 1000 AS ws850 FROM orders GROUP BY 1),
  ss AS (SELECT season, cell_id % 100 AS s_suppkey, max(no2) AS ndvi FROM bs GROUP BY ALL), yy AS (SELECT year(o_orderdate) AS ky, avg(o_totalprice) / 1000 AS ref FROM orders GROUP BY 1)
  SELECT bs.cell_id, bs.month, bs.season, round(no2, 6) AS no2, no2_n, round(ws850, 6) AS ws850, round(ndvi, 6) AS ndvi, cells.size AS road, cells.brand AS alt_road, cells.klass AS cluster, round(coalesce(ref, -1), 6) AS ref_x
  FROM bs LEFT JOIN mm USING (month) LEFT JOIN ss ON ss.season = bs.season AND ss.s_suppkey = bs.cell_id % 100 LEFT JOIN cells ON cells.cell_id = bs.cell_id LEFT JOIN yy ON ky = least(bs.y, 1999)""")
def feature_assembly(spark, sf):
    """Cell-by-month table from layers at (cell, month), month, (cell group, season) and cell grain; reference year clamped."""
    b = monthly_features(spark, sf)
    month = v.table(spark, sf, "orders").groupBy(cal.month_key("o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 1000).alias("ws850"))
    b = b.withColumn("grp", F.col("cell_id") % 100)
    season = b.groupBy("season", "grp").agg(F.max("no2").alias("ndvi"))
    c = v.cells(spark, sf)
    out = features.assemble(b, [(month, ["month"]), (season, ["season", "grp"]), (c.select("cell_id", F.col("klass").alias("cluster")), ["cell_id"])])
    road = c.select("cell_id", F.col("size").alias("road"))
    alt = c.select("cell_id", F.col("brand").alias("road"))
    out = features.prefer(out, road, alt, "cell_id", ["road"])
    ref = v.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("ky")).agg((F.avg("o_totalprice") / 1000).alias("ref_x"))
    out = inventory.clamped_lookup(out, ref.withColumnRenamed("ky", "y"), "y", 1999, "ref_x")
    out = features.complete(out, ["no2", "cluster", "road"]).withColumn("ref_x", F.coalesce("ref_x", F.lit(-1.0)))
    return rnd(out.select("cell_id", "month", "season", "no2", "no2_n", "ws850", "ndvi", "road", "alt_road", "cluster", "ref_x"), 6, "no2", "ws850", "ndvi", "ref_x")


@query(f"""WITH {_FEAT}, s AS (SELECT cell_id, season, avg(no2) AS no2, avg(hcho) AS hcho, avg(sin(radians(wd850))) AS s, avg(cos(radians(wd850))) AS c, count(*) AS n_months FROM bs GROUP BY ALL)
  SELECT cell_id, season, round(no2, 7) AS no2, round(hcho, 9) AS hcho, n_months, round(s / sqrt(s * s + c * c), 5) AS wd850_sin, round(c / sqrt(s * s + c * c), 5) AS wd850_cos FROM s""")
def season_features(spark, sf):
    """Season means with vector-averaged direction and month counts."""
    s = features.season_means(monthly_features(spark, sf), ["no2", "hcho"])
    return rnd(rnd(rnd(s, 7, "no2"), 9, "hcho"), 5, "wd850_sin", "wd850_cos")


@query(f"""WITH {_FEAT} SELECT bs.cell_id, round(avg(no2), 6) AS no2, any_value(p_type) AS klass, any_value(p_size) AS size FROM bs JOIN part ON cell_id = p_partkey GROUP BY 1""")
def cell_summary(spark, sf):
    """Mean of one column with the constant columns of each cell."""
    m = monthly_features(spark, sf).join(v.table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_type").alias("klass"), F.col("p_size").alias("size")), "cell_id")
    return rnd(features.cell_summary(m, "no2", ["klass", "size"]), 6, "no2")


@query(f"""WITH {_FEAT}, x AS (SELECT season, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'outside' ELSE p_type END AS cluster, no2 FROM bs JOIN part ON cell_id = p_partkey)
  SELECT season, cluster, round(sum(no2) / 1000, 6) AS kt FROM x GROUP BY ALL UNION ALL SELECT season, 'all zones', round(sum(CASE WHEN cluster <> 'outside' THEN no2 END) / 1000, 6) FROM x GROUP BY 1""")
def zone_season_totals_kt(spark, sf):
    """Totals per season and zone with the subtotal over the inner zones."""
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), F.when(F.col("p_type").isin("PROMO", "SMALL"), "outside").otherwise(F.col("p_type")).alias("cluster"))
    return rnd(zone_season_totals(join_on(monthly_features(spark, sf), p, ["cell_id"]), "no2"), 6, "kt")


@query("""WITH t AS (SELECT unnest(range(12)) AS i, CAST(2019 + i // 2 AS INTEGER) AS y), m AS (SELECT strftime(o_orderdate, '%Y%m') AS ym, count(*) AS n FROM orders GROUP BY 1),
  k AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS ym FROM orders), f AS (SELECT ym, (CAST(substr(ym, 1, 4) AS INTEGER) + 3) || substr(ym, 5) AS want FROM k)
  SELECT f.ym AS ym, coalesce(a.n, b.n) AS n FROM f LEFT JOIN m a ON a.ym = f.want LEFT JOIN m b ON b.ym = '2000' || substr(f.want, 5)""")
def month_fallback(spark, sf):
    """Lookup of a month key three years on; a missing month falls back to the same month of one fixed year."""
    m = v.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("want")).agg(F.count("*").alias("n"))
    base = m.select(F.col("want").alias("ym"), F.concat((F.substring("want", 1, 4).cast("int") + 3).cast("string"), F.substring("want", 5, 2)).alias("want"))
    out = inventory.clamped_lookup(base, m, "want", "999999", "n", fallback=F.concat(F.lit("2000"), F.substring("want", 5, 2)))
    return out.select("ym", "n")
