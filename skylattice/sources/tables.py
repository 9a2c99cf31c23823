"""Scans: observations, typed text tables, result documents, feature collections, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.values import missing_if_nan, missing_if_sentinel

RING = T.ArrayType(T.ArrayType(T.DoubleType()))


def read_observations(spark: SparkSession, path: str, product: str | None = None, months: tuple[str, str] | None = None) -> DataFrame:
    """Long observation table partitioned by product and month; both filters prune partitions. NaN becomes NULL."""
    df = spark.read.parquet(path)
    if product is not None:
        df = df.where(F.col("product") == product)
    if months is not None:
        df = df.where((F.col("month") >= months[0]) & (F.col("month") < months[1]))
    return df.withColumn("value", missing_if_nan("value"))


def read_text_table(spark: SparkSession, path: str, schema: str, sep: str = ",", date_format: str | None = None) -> DataFrame:
    """CSV with an explicit schema (no inference pass)."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("nanValue", "nan")
    if date_format:
        reader = reader.option("timestampNTZFormat", date_format)
    df = reader.csv(path)
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.select(*[missing_if_nan(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested result documents (one JSON document per file)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def map_rows(df: DataFrame, col: str, key: str, value: str) -> DataFrame:
    """Rows of a MAP column."""
    return df.select(F.explode(col).alias(key, value))


def parse_features(docs: DataFrame, text: str, id_property: str) -> DataFrame:
    """Feature-collection JSON text to one row per polygon: id, exterior ring as ARRAY<STRUCT<x, y>>."""
    schema = ("struct<features:array<struct<properties:map<string,string>,"
              "geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>")
    f = docs.select(F.explode(F.from_json(text, schema)["features"]).alias("f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select(F.col("f.properties")[id_property].alias(id_property), ring.alias("ring"))


def feature_rows(df: DataFrame, id_col: str, ring: str) -> DataFrame:
    """One JSON feature per row; written as text these lines form a feature sequence."""
    coords = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geom = F.struct(F.lit("Polygon").alias("type"), F.array(coords).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col(id_col)).alias("properties"), geom.alias("geometry"))
    return df.select(F.col(id_col), F.to_json(feature).alias("feature"))


def ring_bounds(df: DataFrame, ring: str) -> DataFrame:
    """Bounds over all vertices of all rings."""
    p = df.select(F.explode(ring).alias("p"))
    return p.agg(F.min("p.x").alias("x_min"), F.max("p.x").alias("x_max"), F.min("p.y").alias("y_min"), F.max("p.y").alias("y_max"))


def read_inventory(df: DataFrame, box: tuple[float, float, float, float], keys: Sequence[str] = ("species", "year", "sector")) -> DataFrame:
    """Inventory rows strictly inside a box; sentinel values become NULL. A sector without rows stays absent."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    inside = (F.col("lat") > lat_lo) & (F.col("lat") < lat_hi) & (F.col("lon") > lon_lo) & (F.col("lon") < lon_hi)
    return df.where(inside).select(*keys, "lat", "lon", missing_if_sentinel(missing_if_nan("value")).alias("value"))


def classify(df: DataFrame, tag: str, classes: dict[str, str], out: str = "klass") -> DataFrame:
    """Map tags to classes; rows with another tag are dropped. The map is a short constant."""
    pairs = [x for k, v in classes.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(tag))).where(F.col(out).isNotNull())
