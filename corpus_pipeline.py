"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, and token files."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from skylattice.llm import decontaminate, mixing, quality, similarity_join, token_files  # noqa: E402
from skylattice.llm.queries import TOKENIZER  # noqa: E402
from skylattice.operators.materialise import shared_folder  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return similarity_join.one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as its mixing rate says."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what is read back from them for each document."""
    folder = shared_folder(spark)
    token_files.write_token_files(docs, folder, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, folder)


STAGES: list[tuple[str, Stage]] = [("quality", good_text), ("near_copies", without_near_copies), ("benchmark", without_benchmark), ("mixing", mixed), ("tokens", tokens)]

#: The classifier, the hashed ratios and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
