"""Frozen tables: order-insensitive fingerprint, metadata row, input gate, composite and prediction sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FingerprintMismatch(RuntimeError):
    """The input is not the registered one."""


def row_digest(cols: Sequence[Column]) -> Column:
    """md5 of the row's text form. Separators and backslashes of a text are escaped and NULL is \\N, so that different rows differ."""
    plain = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.md5(F.concat_ws("|", *[F.coalesce(plain(c), F.lit("\\N")) for c in cols]))


def fingerprint(df: DataFrame, cols: Sequence[Column] | None = None) -> DataFrame:
    """One row: row count plus the sum and the xor of 48 digest bits. Independent of row order and partitioning;
    the sum also sees duplicated rows, which cancel in the xor. One mergeable aggregate, no sort."""
    cols = list(cols) if cols is not None else [F.col(c) for c in sorted(df.columns)]
    bits = F.conv(F.substring(row_digest(cols), 1, 12), 16, 10)
    d = df.select(bits.cast("bigint").alias("b"))
    return d.agg(F.count("*").alias("n_rows"), F.sum(F.col("b").cast("decimal(38,0)")).cast("string").alias("digest_sum"),
                 F.coalesce(F.bit_xor("b"), F.lit(0)).cast("string").alias("digest_xor"))


def write_frozen(df: DataFrame, path: str, describe: Sequence[Column] = ()) -> DataFrame:
    """Write the table, then its metadata (fingerprint and `describe` aggregates) next to it as one JSON row."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    stored = df.sparkSession.read.parquet(f"{path}/data")
    meta = fingerprint(stored).withColumn("__k", F.lit(0))
    if describe:
        meta = meta.join(stored.agg(*describe).withColumn("__k", F.lit(0)), "__k")
    meta.drop("__k").write.mode("overwrite").json(f"{path}/meta")
    return stored


def open_frozen(spark: SparkSession, path: str, expected_sum: str, expected_xor: str) -> DataFrame:
    """The stored table, if its recomputed fingerprint is the registered one."""
    df = spark.read.parquet(f"{path}/data")
    got = fingerprint(df).first()
    if (got["digest_sum"], got["digest_xor"]) != (expected_sum, expected_xor):
        raise FingerprintMismatch(path)
    return df


def pixel_composite(obs: DataFrame, value: str, start, end, ts: str = "ts") -> DataFrame:
    """Mean of the valid observations per pixel over [start, end)."""
    return (obs.where((F.col(ts) >= start) & (F.col(ts) < end)).groupBy("iy", "ix")
            .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_valid")))


def predictions_wide(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One prediction column per model name."""
    return long.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))
