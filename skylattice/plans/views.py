"""The shared test tables seen as environmental tables, and the same projections as SQL text.

events    observations: pixel (iy, ix) from user_id, one overpass per day, cloud share from props, product = event_type
signup    events give the weather: one wind vector per overpass, or one reading per event
part      square 1 km cells on a 50-column lattice, with label and feature columns
lineitem  inventory rows (species, year, sector, grid cell)
nation    waypoints, grouped into clusters by region
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.values import qc_value
from skylattice.settings import GridSpec, Quality

LAT_TOP, LON_LEFT, RES, N_COLS = 19.0, 73.4, 0.02, 15
SOURCE = (18.9, 73.54)
QC = Quality(cloud_max=0.8)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def k_of_props():
    return F.get_json_object("props", "$.k").cast("double")


def observations(spark: SparkSession, sf: str, product: str | None = None) -> DataFrame:
    e = table(spark, sf, "events")
    if product is not None:
        e = e.where(F.col("event_type") == product)
    iy, ix = F.expr("cast(user_id div 15 as int)"), (F.col("user_id") % N_COLS).cast("int")
    return e.select("event_id", "ts", F.col("event_type").alias("product"),
                    F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("overpass"), iy.alias("iy"), ix.alias("ix"),
                    (F.lit(LAT_TOP) - F.lit(RES) * iy).alias("lat"), (F.lit(LON_LEFT) + F.lit(RES) * ix).alias("lon"),
                    (k_of_props() / 100).alias("cloud"), (F.col("event_id") % 90).cast("double").alias("sza"), "value")


OBS = """obs AS (SELECT event_id, ts, event_type AS product,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS overpass,
  CAST(user_id // 15 AS INTEGER) AS iy, CAST(user_id % 15 AS INTEGER) AS ix,
  19e0 - 2e-2 * CAST(user_id // 15 AS DOUBLE) AS lat, 73.4e0 + 2e-2 * CAST(user_id % 15 AS DOUBLE) AS lon,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS cloud, CAST(event_id % 90 AS DOUBLE) AS sza, value FROM events)"""


def screened(spark: SparkSession, sf: str) -> DataFrame:
    """All observations, value NULL where quality control fails."""
    o = observations(spark, sf)
    return o.withColumn("value", qc_value(o, q=QC))


CUBE = OBS + """, cube AS (SELECT * REPLACE (CASE WHEN cloud <= 8e-1 AND sza <= 70 THEN value END AS value) FROM obs)"""


def gridded(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (overpass, pixel) with any observation: mean of the valid ones."""
    return screened(spark, sf).groupBy("overpass", "iy", "ix").agg(F.avg("value").alias("value"))


GRIDDED = CUBE + """, g AS (SELECT overpass, iy, ix, avg(value) AS value FROM cube GROUP BY ALL)"""


def winds(spark: SparkSession, sf: str) -> DataFrame:
    """One wind vector and boundary-layer height per overpass."""
    s = table(spark, sf, "events").where(F.col("event_type") == "signup")
    k = k_of_props()
    g = s.groupBy(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("overpass")).agg(
        F.sum(k.cast("bigint")).alias("sk"), F.avg("value").alias("mv"), F.avg(k).alias("mk"))
    return g.select("overpass", F.round(F.col("sk") % 13 - 6 + F.col("mv") / 100, 6).alias("u"),
                    F.round(F.expr("(sk div 13) % 11") - 5 + F.col("mv") / 100, 6).alias("v"), (300 + 10 * F.col("mk")).alias("blh"))


WIND = """wind AS (SELECT overpass, round(sk % 13 - 6 + mv / 100, 6) AS u, round((sk // 13) % 11 - 5 + mv / 100, 6) AS v,
    300 + 10 * mk AS blh
  FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS overpass,
          CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sk, avg(value) AS mv,
          avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mk
        FROM events WHERE event_type = 'signup' GROUP BY 1))"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Single weather readings (signup events): time and wind."""
    s = table(spark, sf, "events").where(F.col("event_type") == "signup")
    k = k_of_props()
    return s.select(F.col("event_id").alias("met_id"), F.col("ts").alias("met_ts"), (k % 13 - 6 + F.col("value") / 100).alias("u"),
                    (k * 7 % 11 - 5 + F.col("value") / 100).alias("v"), (300 + 10 * k).alias("blh"))


MET = """met AS (SELECT event_id AS met_id, ts AS met_ts, k % 13 - 6 + value / 100 AS u, k * 7 % 11 - 5 + value / 100 AS v, 300 + 10 * k AS blh
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'signup'))"""


@lru_cache(maxsize=8)
def _pixel_rows(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "events").agg(F.max("user_id")).first()[0] // N_COLS + 1


def grid(spark: SparkSession, sf: str) -> GridSpec:
    """The pixel grid; its row count is configuration in production and read once from the table bounds here."""
    return GridSpec(LAT_TOP, LON_LEFT, RES, _pixel_rows(spark, sf), N_COLS)


# the dense pixel grid as SQL
PIX = """pix AS (SELECT CAST(r.i AS INTEGER) AS iy, CAST(c.i AS INTEGER) AS ix, 19e0 - 2e-2 * r.i AS lat, 73.4e0 + 2e-2 * c.i AS lon
  FROM (SELECT unnest(range((SELECT max(user_id) // 15 + 1 FROM events))) AS i) r, (SELECT unnest(range(15)) AS i) c)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    cx, cy = (F.col("p_partkey") % 50), F.expr("p_partkey div 50")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("cell_id"), cx.alias("cx"), cy.alias("cy"), (cx + 0.5).alias("x"), (cy + 0.5).alias("y"),
        (F.lit(18.99) - F.lit(0.0047) * cy).alias("lat"), (F.lit(73.39) + F.lit(0.0061) * cx).alias("lon"),
        F.col("p_retailprice").alias("label"), F.col("p_size").cast("double").alias("size"),
        F.substring_index("p_brand", "#", -1).cast("double").alias("brand"), F.col("p_type").alias("klass"))


CELLS = """cells AS (SELECT p_partkey AS cell_id, p_partkey % 50 AS cx, p_partkey // 50 AS cy, p_partkey % 50 + 5e-1 AS x, p_partkey // 50 + 5e-1 AS y,
  18.99e0 - 4.7e-3 * (p_partkey // 50) AS lat, 73.39e0 + 6.1e-3 * (p_partkey % 50) AS lon, p_retailprice AS label,
  CAST(p_size AS DOUBLE) AS size, CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand, p_type AS klass FROM part)"""


def waypoints(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(k.alias("wp"), F.col("n_name").alias("wp_name"), F.col("r_name").alias("cluster"),
                    (F.lit(18.82) + F.lit(0.008) * k).alias("wp_lat"), (F.lit(73.42) + F.lit(0.01) * (k * 7 % 25)).alias("wp_lon"),
                    (k % 5 * 10 + 4.0).alias("wp_x"), (F.expr("n_nationkey div 5") * 8 + 3.0).alias("wp_y")))


WAY = """way AS (SELECT n_nationkey AS wp, n_name AS wp_name, r_name AS cluster, 18.82e0 + 8e-3 * n_nationkey AS wp_lat,
  73.42e0 + 1e-2 * (n_nationkey * 7 % 25) AS wp_lon, n_nationkey % 5 * 10 + 4e0 AS wp_x, (n_nationkey // 5) * 8 + 3e0 AS wp_y
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    sup = F.col("l_suppkey")
    species = F.array(F.struct(F.lit("NOx").alias("species"), (F.col("l_quantity") / 10).alias("value")),
                      F.struct(F.lit("CO2").alias("species"), (F.col("l_extendedprice") / 10).alias("value")),
                      F.struct(F.lit("CO").alias("species"), (F.col("l_quantity") * (1 + 20 * F.col("l_tax")) / 10).alias("value")))
    return (l.join(p.select("p_partkey", "p_type"), l.l_partkey == p.p_partkey)
            .select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month_no"), F.col("p_type").alias("sector"),
                    (F.lit(18.65) + F.lit(0.1) * (sup % 5)).alias("lat"), (F.lit(73.25) + F.lit(0.1) * F.expr("l_suppkey div 5 % 6")).alias("lon"),
                    F.explode(species).alias("s")).select("*", "s.*").drop("s"))


INV = """inv AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month_no, p_type AS sector,
    18.65e0 + 1e-1 * (l_suppkey % 5) AS lat, 73.25e0 + 1e-1 * (l_suppkey // 5 % 6) AS lon, s.species, s.value
  FROM (SELECT *, unnest([{'species': 'NOx', 'value': l_quantity / 10}, {'species': 'CO2', 'value': l_extendedprice / 10},
      {'species': 'CO', 'value': l_quantity * (1 + 20 * l_tax) / 10}]) AS s FROM lineitem JOIN part ON l_partkey = p_partkey))"""
