"""Written intermediate tables for iterative operators.

An iterative plan would recompute its inputs in every round. Small per-round results are written to the shared
folder the cluster names in spark.checkpoint.dir and read back, so lost executors never lose finished rounds. A
local folder is used only where that setting is absent (single-machine tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skylattice-")
    return f"{base.rstrip('/')}/skylattice-{uuid.uuid4().hex}"


def materialise(df: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """The rows, written once; filters on the columns `parts` then read the matching files only."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession) -> int:
    """Partitions for compute-heavy expansions of small tables, which size-based coalescing would put in one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
