"""Scans, quality control, coverage, calendar and as-of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import calendar as cal
from skylattice.functions import geodesy as geo
from skylattice.functions import values as val
from skylattice.functions.hashing import uniform
from skylattice.operators import coverage, qc, spatial
from skylattice.operators.asof import asof_join, rounded_hour_join
from skylattice.operators.features import spot_check, weather_by_month
from skylattice.operators.quantiles import exact_quantiles
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.sources.freeze import pixel_composite


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- flagship
@query(f"""WITH {v.CUBE}, {v.WAY},
  px AS (SELECT iy, ix, min(lat) AS lat, min(lon) AS lon, avg(value) AS m, count(value) AS n FROM cube GROUP BY ALL),
  near AS (SELECT p.*, w.cluster, row_number() OVER (PARTITION BY iy, ix ORDER BY (w.wp_lat - p.lat)*(w.wp_lat - p.lat) + (w.wp_lon - p.lon)*(w.wp_lon - p.lon), w.wp) AS rn
    FROM px p, way w)
  SELECT zone, round(sum(m), 6) AS total, CAST(sum(n) AS BIGINT) AS n_valid, count(*) AS n_pixels FROM (
    SELECT cluster AS zone, m, n FROM near WHERE rn = 1
    UNION ALL SELECT 'r5km', m, n FROM near WHERE rn = 1 AND sqrt(pow((lon - 73.54e0) * 111.32e0 * cos(radians(18.9e0)), 2) + pow((lat - 18.9e0) * 110.574e0, 2)) <= 5
    UNION ALL SELECT 'r10km', m, n FROM near WHERE rn = 1 AND sqrt(pow((lon - 73.54e0) * 111.32e0 * cos(radians(18.9e0)), 2) + pow((lat - 18.9e0) * 110.574e0, 2)) <= 10)
  GROUP BY zone""")
def qc_masked_pixel_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Screened observations, mean and count per pixel, nearest waypoint's cluster, overlapping zone totals."""
    px = v.screened(spark, sf).groupBy("iy", "ix", "lat", "lon").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    near = spatial.nearest_point(px, v.waypoints(spark, sf), "lat", "lon", "wp_lat", "wp_lon", ["cluster"], order="wp")
    d = geo.distance_km("lat", "lon", F.lit(v.SOURCE[0]), F.lit(v.SOURCE[1]))
    zones = {"r5km": d <= 5, "r10km": d <= 10}
    named = near.select("m", "n", F.col("cluster").alias("zone")).unionByName(spatial.with_zones(near, zones).select("m", "n", "zone"))
    return named.groupBy("zone").agg(r6(F.sum("m")).alias("total"), F.sum("n").alias("n_valid"), F.count("*").alias("n_pixels"))


@query(f"""WITH {v.CUBE} SELECT iy, ix, round(avg(value), 6) AS mean_value, count(value) AS n_valid FROM cube
  WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY ALL""")
def composite_export(spark, sf):
    """QC'd mean composite of a half-open date range."""
    lo, hi = F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-22").cast("timestamp_ntz")
    return pixel_composite(v.screened(spark, sf), "value", lo, hi).withColumn("mean_value", r6("mean_value"))


@query(f"""WITH {v.OBS} SELECT product, count(*) AS n, count(CASE WHEN cloud <= 3e-1 AND sza <= 70 THEN 1 END) AS n_pass,
    count(CASE WHEN cloud <= 3e-1 AND sza <= 70 AND (100 - cloud * 100) / 100 >= 8e-1 THEN 1 END) AS n_pass_qa,
    count(CASE WHEN event_id % 12 IN (4, 5, 6, 7) THEN 1 END) AS n_kept_classes,
    count(CASE WHEN value > 5 THEN 1 END) AS n_above_sentinel FROM obs GROUP BY product""")
def qc_masks(spark, sf):
    """Cloud / zenith mask with and without an optional qa column, scene-class keep list, sentinel to missing."""
    o = v.observations(spark, sf)
    with_qa = o.withColumn("qa", (100 - F.col("cloud") * 100) / 100)
    strict = val.qc_value(with_qa, q=v.Quality(qa_min=0.8))
    return with_qa.groupBy("product").agg(
        F.count("*").alias("n"), F.count(val.qc_value(o)).alias("n_pass"), F.count(strict).alias("n_pass_qa"),
        F.count(val.keep_classes("value", F.col("event_id") % 12)).alias("n_kept_classes"),
        F.count(val.missing_if_sentinel("value", 5.0)).alias("n_above_sentinel"))


# ---------------------------------------------------------------- calendar
@query("""SELECT season, month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
    SELECT CAST(y AS VARCHAR) || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice
    FROM (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END AS y FROM orders) WHERE month(o_orderdate) IN (10,11,12,1,2,3,4,5))
  GROUP BY ALL""")
def season_totals(spark, sf):
    """Season-month filter, season and month labels, totals."""
    o = v.table(spark, sf, "orders").where(cal.in_season("o_orderdate"))
    return (o.groupBy(cal.season_label("o_orderdate").alias("season"), cal.month_key("o_orderdate").alias("month"))
            .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, max(o_orderdate) AS z FROM orders),
  m AS (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS s FROM b),
  k AS (SELECT CAST(s AS DATE) AS month_start, CAST(s + INTERVAL 1 MONTH AS DATE) AS next_start FROM m WHERE month(s) IN (10,11,12,1,2,3,4,5))
  SELECT month_start, next_start, count(o_orderkey) AS n FROM k LEFT JOIN orders ON o_orderdate >= month_start AND o_orderdate < next_start GROUP BY ALL""")
def season_month_filter(spark, sf):
    """Half-open season months of the data period, and the rows in each; months without rows stay."""
    o = v.table(spark, sf, "orders")
    span = o.agg(F.min("o_orderdate").alias("a"), (F.max("o_orderdate") + F.expr("interval 1 day")).alias("z"))
    months = (span.select(F.explode(cal.month_starts("a", "z")).alias("month_start")).where(cal.in_season("month_start"))
              .withColumn("next_start", F.add_months("month_start", 1)))
    per = o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month_start")).agg(F.count("*").alias("n"))
    return months.join(per, "month_start", "left").fillna(0, ["n"])


@query("""WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us FROM events),
  h AS (SELECT *, us // 3600000000 AS h0, us % 3600000000 AS rest FROM e),
  r AS (SELECT *, h0 + CASE WHEN rest > 1800000000 OR (rest = 1800000000 AND h0 % 2 = 1) THEN 1 ELSE 0 END AS hh FROM h)
  SELECT CAST(make_timestamp(hh * 3600000000) AS TIMESTAMP) AS hour_ts, count(*) AS n, min(hour(ts + INTERVAL 330 MINUTE)) AS min_local_hour,
    max(isodow(ts + INTERVAL 330 MINUTE) - 1) AS max_local_dow FROM r GROUP BY 1""")
def hour_rounding(spark, sf):
    """Nearest hour with half hours to even, local clock parts by fixed shift."""
    e = v.table(spark, sf, "events")
    loc = cal.local_time("ts")
    return e.groupBy(cal.round_to_hour("ts").alias("hour_ts")).agg(
        F.count("*").alias("n"), F.min(F.hour(loc)).cast("bigint").alias("min_local_hour"), F.max(F.weekday(loc)).cast("bigint").alias("max_local_dow"))


@query("""SELECT event_id, make_timestamp((event_id * 86399977 + 1) * 1000) AS from_millis,
    make_timestamp(CAST(round(value * 1000) AS BIGINT) * 1000000 + 250000) AS from_seconds FROM events""")
def epoch_decode(spark, sf):
    """Epoch milliseconds and fractional epoch seconds to zone-free timestamps."""
    e = v.table(spark, sf, "events")
    return e.select("event_id", cal.from_epoch_millis(F.col("event_id") * 86399977 + 1).alias("from_millis"),
                    cal.from_epoch_seconds(F.round(F.col("value") * 1000) + 0.25).alias("from_seconds"))


# ---------------------------------------------------------------- coverage
@query(f"""WITH {v.CUBE}, d AS (SELECT overpass, count(value) AS n_valid, count(*) AS n_all, avg(value) AS m FROM cube GROUP BY 1)
  SELECT overpass, n_valid, n_all, round(m, 6) AS mean_value, round(n_valid / n_all, 6) AS valid_fraction FROM d WHERE n_valid / n_all >= 6e-1""")
def usable_overpasses(spark, sf):
    """Overpasses whose valid share reaches the threshold."""
    return (qc.overpass_coverage(qc.usable_overpasses(v.screened(spark, sf), 0.6))
            .withColumn("mean_value", r6("mean_value")).withColumn("valid_fraction", r6("valid_fraction")))


@query(f"""WITH {v.CUBE}, d AS (SELECT CAST(ts AS DATE) AS day, count(value) AS nv, count(*) AS na FROM cube GROUP BY 1),
  spine AS (SELECT strftime(s, '%Y-%m') AS month FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS s FROM (SELECT least(TIMESTAMP '2023-10-01', date_trunc('month', min(ts))) AS a, greatest(TIMESTAMP '2024-05-01', date_trunc('month', max(ts))) AS b FROM events))),
  m AS (SELECT strftime(day, '%Y-%m') AS month, count(CASE WHEN nv > 0 THEN 1 END) AS a, count(CASE WHEN nv / na >= 6e-1 THEN 1 END) AS u FROM d GROUP BY 1)
  SELECT month, coalesce(a, 0) AS days_any, coalesce(u, 0) AS days_usable FROM spine LEFT JOIN m USING (month)""")
def monthly_coverage(spark, sf):
    """Days with any valid pixel and usable days per month of the season and of the data; months without data count 0."""
    day = F.to_date("ts")
    ends = v.table(spark, sf, "events").agg(F.least(F.lit("2023-10-01").cast("date"), F.min(day)).alias("a"),
                                            F.greatest(F.lit("2024-06-01").cast("date"), F.add_months(F.trunc(F.max(day), "month"), 1)).alias("b"))
    spine = ends.select(F.explode(cal.month_starts("a", "b")).alias("s")).select(cal.month_key("s").alias("month"))
    return coverage.monthly_usable_days(v.screened(spark, sf), "ts", "value", 0.6, spine)


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT CASE WHEN o_totalprice > 2e5 THEN CAST(o_orderdate AS DATE) END) AS d FROM orders GROUP BY 1)
  SELECT count(*) AS n_months, median(d) AS median_days, min(d) AS min_days, count(CASE WHEN d = 0 THEN 1 END) AS empty_months FROM m""")
def coverage_summary(spark, sf):
    """Median and minimum of distinct usable days over the months."""
    o = v.table(spark, sf, "orders")
    m = o.groupBy(cal.month_key("o_orderdate").alias("month")).agg(
        F.count_distinct(F.when(F.col("o_totalprice") > 2e5, F.to_date("o_orderdate"))).alias("days_usable"))
    return coverage.coverage_summary(m)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
  SELECT CAST(month(day) AS INTEGER) AS month_no, round(avg(n), 6) AS mean_count, CAST((month(day) + 2) % 12 AS INTEGER) AS season_pos FROM d GROUP BY ALL""")
def month_climatology(spark, sf):
    """Mean daily count by calendar month in season order."""
    d = v.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return coverage.month_climatology(d, "day", "n").withColumn("mean_count", r6("mean_count"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS d, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
  SELECT CAST(d AS DATE) AS day, count(*) AS n, round(avg(CASE WHEN q >= 5 THEN 1e0 ELSE 0e0 END), 2) AS flag_share FROM f GROUP BY 1 HAVING count(*) >= 5""")
def daily_conditional_counts(spark, sf):
    """First delivery per sounding id, then daily counts with a conditional share and a minimum count."""
    l = v.table(spark, sf, "lineitem")
    one = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("d"), F.min("l_quantity").alias("q"))
    return coverage.daily_counts(one, F.to_date("d"), F.col("q") >= 5, 5)


@query("""WITH x AS (SELECT CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber = 7 THEN 'beta' ELSE CAST(10 + l_linenumber AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INTEGER) % 4 AS VARCHAR) || 'r' END AS ver,
    l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS arrival, l_quantity FROM lineitem),
  y AS (SELECT *, CASE WHEN ver = 'beta' THEN -1e0 ELSE CAST(regexp_extract(ver, '^[0-9.]+') AS DOUBLE) END AS num FROM x)
  SELECT day, ver, arrival FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY num DESC, arrival, l_quantity) AS rn FROM y) WHERE rn = 1""")
def latest_version_per_key(spark, sf):
    """Numerically newest version per day; unparsable texts rank lowest, ties keep the first arrival."""
    l = v.table(spark, sf, "lineitem")
    ver = F.when(F.col("l_linenumber") == 7, F.lit("beta")).otherwise(
        F.concat((10 + F.col("l_linenumber")).cast("string"), F.lit("."), (F.col("l_quantity").cast("int") % 4).cast("string"), F.lit("r")))
    arrival = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    x = l.select(F.to_date("l_shipdate").alias("day"), ver.alias("ver"), arrival.alias("arrival"))
    return coverage.newest_version(x, ["day"], "ver", "arrival")


@query("""SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def first_and_last_per_key(spark, sf):
    """First and last row per key by an explicit order, as mergeable aggregates."""
    o = v.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = F.struct("o_orderdate", "o_orderkey")
    a = coverage.first_per_key(o, ["o_custkey"], order).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    b = coverage.first_per_key(o, ["o_custkey"], order, last=True).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return a.join(b, "o_custkey")


@query("""WITH s AS (SELECT hour(ts + INTERVAL 330 MINUTE) AS h FROM events), n AS (SELECT h, count(*) AS c FROM s GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS part, round(coalesce(c, 0) / (SELECT count(*) FROM events), 6) AS share FROM (SELECT unnest(range(24)) AS i) LEFT JOIN n ON h = i""")
def hour_shares(spark, sf):
    """Share of observations per local clock hour on a dense 24-hour spine."""
    return coverage.share_on_spine(v.table(spark, sf, "events"), F.hour(cal.local_time("ts")), 24).withColumn("share", r6("share"))


@query(f"""WITH {v.CUBE}, c AS (SELECT *, CAST(overpass // 10 AS INTEGER) AS season, CASE WHEN iy < 3 THEN 'north' WHEN iy < 6 THEN 'middle' ELSE 'south' END AS zone FROM cube),
  px AS (SELECT season, iy, ix, avg(value) AS value FROM c GROUP BY ALL), bg AS (SELECT season, quantile_cont(value, 0.1) AS background FROM px GROUP BY 1),
  z AS (SELECT season, zone, avg(value) AS zm, stddev_samp(value) AS zs, count(value) AS n FROM c GROUP BY ALL)
  SELECT season, zone, round(zm, 6) AS zone_mean, round(zs, 6) AS zone_sd, n, round(background, 6) AS background, round(zm / background, 6) AS ratio FROM z JOIN bg USING (season)""")
def enhancement_ratio(spark, sf):
    """Zone mean over the regional p10 per season."""
    c = (v.screened(spark, sf).withColumn("season", F.expr("overpass div 10").cast("int"))
         .withColumn("zone", F.when(F.col("iy") < 3, "north").when(F.col("iy") < 6, "middle").otherwise("south")))
    px = c.groupBy("season", "iy", "ix").agg(F.avg("value").alias("value"))
    e = coverage.enhancement_ratio(c, px, "season")
    return e.select("season", "zone", r6("zone_mean").alias("zone_mean"), r6("zone_sd").alias("zone_sd"), "n", r6("background").alias("background"), r6("ratio").alias("ratio"))


@query(f"""WITH {v.CELLS}, o AS (SELECT c.cell_id, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS value, sqrt((x - 25) * (x - 25) + (y - 20) * (y - 20)) * 2 AS d
    FROM lineitem JOIN cells c ON l_partkey = cell_id WHERE month(l_shipdate) IN (3, 4, 5)),
  p AS (SELECT year, avg(CASE WHEN d <= 10 THEN value END) AS a, avg(CASE WHEN d >= 35 AND d <= 45 THEN value END) AS b FROM o GROUP BY 1),
  e AS (SELECT *, a - b AS x FROM p)
  SELECT year, round(a, 6) AS core_mean, round(b, 6) AS rural_mean, round(x, 6) AS excess, round(100 * (x - first(x) OVER (ORDER BY year)) / first(x) OVER (ORDER BY year), 4) AS change_pct FROM e""")
def urban_excess(spark, sf):
    """Core mean minus ring mean in one calendar window of each year, and the change from the first year."""
    c = v.cells(spark, sf)
    o = v.table(spark, sf, "lineitem").join(c, F.col("l_partkey") == F.col("cell_id"))
    d = F.sqrt((F.col("x") - 25) * (F.col("x") - 25) + (F.col("y") - 20) * (F.col("y") - 20)) * 2
    e = coverage.urban_excess(o, d, F.month("l_shipdate").isin(3, 4, 5), F.year("l_shipdate"), "l_quantity")
    return e.select("year", r6("core_mean").alias("core_mean"), r6("rural_mean").alias("rural_mean"), r6("excess").alias("excess"), F.round("change_pct", 4).alias("change_pct"))


@query(f"""WITH {v.WAY}, r AS (SELECT wp, wp_lat + 1e-4 * (wp * 37 % 90) AS rlat, wp_lon - 1e-4 * (wp * 53 % 70) AS rlon FROM way),
  d AS (SELECT wp, 2 * 6371000 * asin(sqrt(pow(sin((radians(rlat) - radians(wp_lat)) / 2), 2) + cos(radians(wp_lat)) * cos(radians(rlat)) * pow(sin((radians(rlon) - radians(wp_lon)) / 2), 2))) AS m FROM way JOIN r USING (wp))
  SELECT wp, round(m, 4) AS distance_m, m > 500 AS displaced FROM d""")
def waypoint_displacement(spark, sf):
    """Great-circle displacement of waypoints against a reference list, flagged beyond 500 m."""
    w = v.waypoints(spark, sf).select("wp", F.col("wp_lat").alias("lat"), F.col("wp_lon").alias("lon"))
    ref = w.select("wp", (F.col("lat") + F.lit(1e-4) * (F.col("wp") * 37 % 90)).alias("lat"), (F.col("lon") - F.lit(1e-4) * (F.col("wp") * 53 % 70)).alias("lon"))
    return coverage.displacement_check(w, ref, "wp").select("wp", F.round("distance_m", 4).alias("distance_m"), "displaced")


# ---------------------------------------------------------------- wind
@query(f"""WITH {v.MET} SELECT met_id, round(sqrt(u * u + v * v), 6) AS ws, round(((270 - degrees(atan2(v, u))) % 360 + 360) % 360, 5) AS wd FROM met""")
def wind_components(spark, sf):
    """Wind speed and direction-from of every reading."""
    return v.readings(spark, sf).select("met_id", r6(geo.wind_speed("u", "v")).alias("ws"), F.round(geo.wind_from_deg("u", "v"), 5).alias("wd"))


@query(f"""WITH {v.MET}, d AS (SELECT *, ((270 - degrees(atan2(v, u))) % 360 + 360) % 360 AS wd FROM met)
  SELECT strftime(met_ts, '%Y-%m') AS month, round(avg(sqrt(u * u + v * v)), 6) AS ws850, round(avg(blh), 6) AS blh_m, round(avg(CASE WHEN wd >= 45 AND wd < 180 THEN 1e0 ELSE 0e0 END), 6) AS frac_ese,
    round(((270 - degrees(atan2(avg(v), avg(u)))) % 360 + 360) % 360, 4) AS wd850 FROM d GROUP BY 1""")
def vector_mean_direction(spark, sf):
    """Monthly weather: mean speed, direction of the mean vector, share of one wind sector."""
    w = weather_by_month(v.readings(spark, sf), "met_ts")
    return w.select("month", r6("ws850").alias("ws850"), r6("blh_m").alias("blh_m"), r6("frac_ese").alias("frac_ese"), F.round("wd850", 4).alias("wd850"))


# ---------------------------------------------------------------- joins in time
_ASOF = """SELECT event_id, met_id FROM (SELECT o.event_id, m.met_id, row_number() OVER (PARTITION BY o.event_id ORDER BY {order}) AS rn
    FROM (SELECT event_id, ts FROM events WHERE event_type = 'purchase') o LEFT JOIN (SELECT met_ts, max_by(met_id, met_id) AS met_id FROM met GROUP BY 1) m ON {cond}) WHERE rn = 1"""


@query(f"WITH {v.MET} " + _ASOF.format(order="abs(epoch_us(o.ts) - epoch_us(m.met_ts)), m.met_ts", cond="abs(epoch_us(o.ts) - epoch_us(m.met_ts)) <= 1800000000"))
def asof_nearest(spark, sf):
    """Nearest weather reading within 30 minutes of each observation."""
    o = v.observations(spark, sf, "purchase").select("event_id", "ts")
    return asof_join(o, v.readings(spark, sf), "ts", "met_ts", right_cols=["met_id"], right_order="met_id", tolerance_s=1800).select("event_id", "met_id")


@query(f"WITH {v.MET} " + _ASOF.format(order="m.met_ts DESC", cond="m.met_ts <= o.ts"))
def asof_backward(spark, sf):
    """Last reading at or before each observation, without a tolerance."""
    o = v.observations(spark, sf, "purchase").select("event_id", "ts")
    return asof_join(o, v.readings(spark, sf), "ts", "met_ts", right_cols=["met_id"], right_order="met_id", direction="backward").select("event_id", "met_id")


@query("""SELECT event_id, click_id FROM (SELECT o.event_id, c.event_id AS click_id, row_number() OVER (PARTITION BY o.event_id ORDER BY c.ts, c.event_id DESC) AS rn
    FROM (SELECT * FROM events WHERE event_type = 'purchase') o LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
      ON o.user_id = c.user_id AND c.ts >= o.ts AND epoch_us(c.ts) - epoch_us(o.ts) <= 172800000000) WHERE rn = 1""")
def asof_forward_by_key(spark, sf):
    """Next click of the same user within two days of each purchase."""
    e = v.table(spark, sf, "events")
    o = e.where(F.col("event_type") == "purchase").select("event_id", "ts", "user_id")
    c = e.where(F.col("event_type") == "click").select(F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"), "user_id")
    return asof_join(o, c, "ts", "click_ts", by=["user_id"], right_cols=["click_id"], right_order="click_id", direction="forward",
                     tolerance_s=172800).select("event_id", "click_id")


@query(f"""WITH {v.MET}, m AS (SELECT date_trunc('hour', met_ts) AS h, avg(u) AS u, avg(v) AS v FROM met GROUP BY 1),
  e AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'), h AS (SELECT *, us // 3600000000 AS h0, us % 3600000000 AS rest FROM e),
  r AS (SELECT event_id, make_timestamp((h0 + CASE WHEN rest > 1800000000 OR (rest = 1800000000 AND h0 % 2 = 1) THEN 1 ELSE 0 END) * 3600000000) AS hh FROM h)
  SELECT event_id, round(u, 6) AS u, round(v, 6) AS v FROM r LEFT JOIN m ON hh = h""")
def hour_rounded_join(spark, sf):
    """Left join of overpasses to hourly weather on the rounded hour; unmatched rows keep NULL."""
    m = v.readings(spark, sf).groupBy(F.date_trunc("hour", "met_ts").cast("timestamp_ntz").alias("h")).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    o = v.observations(spark, sf, "view").select("event_id", "ts")
    return rounded_hour_join(o, m, "ts", "h").select("event_id", r6("u").alias("u"), r6("v").alias("v"))


# ---------------------------------------------------------------- outliers
_FENCED = """q AS (SELECT {key}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {src} GROUP BY ALL),
  f AS (SELECT c.*, coalesce(value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1), false) AS bad FROM {src} c LEFT JOIN q USING ({key}))"""


@query(f"WITH {v.CUBE}, {_FENCED.format(key='iy, ix', src='cube')} SELECT iy, ix, count(CASE WHEN bad THEN 1 END) AS n_removed, round(sum(CASE WHEN NOT bad THEN value END), 6) AS kept_sum FROM f GROUP BY ALL")
def iqr_temporal(spark, sf):
    """Fences of each pixel's time series."""
    f = qc.iqr_filter(v.screened(spark, sf), "temporal", k=1.5)
    return f.groupBy("iy", "ix").agg(F.count_if("is_outlier").alias("n_removed"), r6(F.sum("value")).alias("kept_sum"))


@query(f"WITH {v.CUBE}, {_FENCED.format(key='overpass', src='cube')} SELECT overpass, count(CASE WHEN bad THEN 1 END) AS n_removed, round(sum(CASE WHEN NOT bad THEN value END), 6) AS kept_sum FROM f GROUP BY ALL")
def iqr_domain(spark, sf):
    """Fences of all pixels of each overpass."""
    f = qc.iqr_filter(v.screened(spark, sf), "domain", k=1.5)
    return f.groupBy("overpass").agg(F.count_if("is_outlier").alias("n_removed"), r6(F.sum("value")).alias("kept_sum"))


# mirrored position p of an axis of length n, as SQL
def mirror(p: str, n: str) -> str:
    return f"CASE WHEN (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({p}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"


NROWS = "(SELECT max(user_id) // 15 + 1 FROM events)"


@query(f"""WITH {v.GRIDDED}, {v.PIX}, nn AS (SELECT {NROWS} AS nr), days AS (SELECT DISTINCT overpass FROM g WHERE value IS NOT NULL),
  med AS (SELECT overpass, quantile_cont(value, 0.5) AS m FROM g GROUP BY 1),
  full_ AS (SELECT d.overpass, p.iy, p.ix, coalesce(g.value, med.m) AS z FROM days d CROSS JOIN pix p LEFT JOIN g ON g.overpass = d.overpass AND g.iy = p.iy AND g.ix = p.ix JOIN med ON med.overpass = d.overpass),
  off AS (SELECT a.i AS a, b.i AS b FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b),
  sm AS (SELECT g.overpass, g.iy, g.ix, any_value(g.value) AS value, quantile_cont(z, 0.5) AS s FROM g CROSS JOIN off CROSS JOIN nn
     JOIN full_ f ON f.overpass = g.overpass AND f.iy = {mirror('g.iy + a', 'nr')} AND f.ix = {mirror('g.ix + b', '15')} WHERE g.value IS NOT NULL GROUP BY ALL),
  dv AS (SELECT *, value - s AS dev FROM sm), q AS (SELECT overpass, quantile_cont(dev, 0.25) AS q1, quantile_cont(dev, 0.75) AS q3 FROM dv GROUP BY 1)
  SELECT overpass, count(CASE WHEN dev < q1 - 3 * (q3 - q1) OR dev > q3 + 3 * (q3 - q1) THEN 1 END) AS n_removed, count(*) AS n_seen FROM dv JOIN q USING (overpass) GROUP BY 1""")
def iqr_local(spark, sf):
    """Fences of each overpass's deviations from the local 3 x 3 median."""
    f = qc.iqr_filter(v.gridded(spark, sf), "local", k=3.0, size=3, spec=v.grid(spark, sf))
    return (f.groupBy("overpass").agg(F.count_if("is_outlier").alias("n_removed"), (F.count("value") + F.count_if("is_outlier")).alias("n_seen"))
            .where(F.col("n_seen") > 0))


@query(f"""WITH {v.CUBE} SELECT overpass, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.975), 6) AS p97_5 FROM cube WHERE value IS NOT NULL GROUP BY 1""")
def exact_percentiles(spark, sf):
    """Linearly interpolated percentiles per overpass, computed over value buckets."""
    q = exact_quantiles(v.screened(spark, sf), ["overpass"], "value", {"p5": 0.05, "p10": 0.10, "p50": 0.5, "p97_5": 0.975})
    return q.select("overpass", *[r6(c).alias(c) for c in ("p5", "p10", "p50", "p97_5")])


@query("""SELECT p_partkey, p_type FROM part ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)) LIMIT 8""")
def spot_check_sample(spark, sf):
    """Eight reproducible sample rows by seeded hash order."""
    return spot_check(v.table(spark, sf, "part"), F.col("p_partkey")).select("p_partkey", "p_type")


@query("""SELECT event_id, round((CAST('0x' || substr(md5('7:' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0, 9) AS u FROM events""")
def hashed_uniform(spark, sf):
    """Engine-independent uniform numbers."""
    return v.table(spark, sf, "events").select("event_id", F.round(uniform(7, "event_id"), 9).alias("u"))


