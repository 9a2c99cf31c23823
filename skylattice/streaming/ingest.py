"""Incremental ingestion: exactly-once files, re-delivery, counts kept current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skylattice.operators.materialise import shared_folder


def watch_files(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def undelivered(batch: DataFrame, stored: DataFrame | None, key: str, day: str) -> DataFrame:
    """The rows of `batch` whose key is not among the stored rows of their day, each key once.

    A row delivered again has the day it had before, so only the stored days that the batch touches are read, and rows of
    any age are taken. Rows without a key cannot be recognised and all stay.
    """
    once = batch.where(F.col(key).isNotNull()).dropDuplicates([day, key]).unionByName(batch.where(F.col(key).isNull()))
    if stored is None:
        return once
    days = batch.select(day).distinct()
    known = stored.select(F.col(day).alias("__day"), F.col(key).alias("__key"))
    known = known.join(days, F.expr(f"__day <=> `{day}`"), "left_semi")
    return once.join(known, F.expr(f"`{key}` = __key AND `{day}` <=> __day"), "left_anti")


def ingest(stream: DataFrame, out: str, checkpoint: str, day: str, key: str | None = None) -> StreamingQuery:
    """Write all available rows, one folder per (micro-batch, day); with `key`, rows delivered again are left out.

    A repeated micro-batch overwrites exactly the folder it wrote before and compares itself with earlier batches only, so a
    lost executor or driver neither duplicates nor loses rows; the checkpoint records finished files, including empty ones.
    The table and the checkpoint belong together.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if key is not None:
            stored = None
            if batch_id > 0:
                schema = T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])
                stored = batch.sparkSession.read.schema(schema).parquet(out).where(F.col("batch_id") < batch_id)
            batch = undelivered(batch, stored, key, day)
        batch.write.mode("overwrite").partitionBy(day).parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_counts(stream: DataFrame, ts: str, valid: str, out: str, checkpoint: str) -> StreamingQuery:
    """Per-day row and valid counts, kept current: each micro-batch stores the changed days."""
    per = (stream.groupBy(F.window(ts, "1 day").alias("w"))
           .agg(F.count("*").alias("n_all"), F.count_if(F.col(valid)).alias("n_valid"))
           .select(F.col("w.start").alias("day_start"), "n_all", "n_valid"))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    return (per.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out: str, key: str = "day_start") -> DataFrame:
    """Newest stored count of every day."""
    t = spark.read.parquet(out)
    rest = [c for c in t.columns if c not in (key, "batch_id")]
    return t.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("__r")).select(key, "__r.*")


def pending(candidates: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions that are not materialised yet; finished keys count even when they held no rows."""
    return candidates.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_log(batch: DataFrame, path: str, done_path: str, keys: Sequence[str], scanned: DataFrame, part: str) -> None:
    """Append rows with their provenance columns, then record the scanned keys (with or without rows) as done.

    Rows go first and each `part` (granule) folder is replaced as a whole, so a retry after a failure between the two writes
    leaves the same table.
    """
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    scanned.select(*keys).distinct().write.mode("append").parquet(done_path)


__all__ = ["append_log", "daily_counts", "ingest", "latest_counts", "pending", "shared_folder", "undelivered", "watch_files"]
