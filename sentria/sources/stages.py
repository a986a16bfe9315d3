"""Stages that are kept, and choice among the parts of a source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: read if it was finished before, else built and written. A write that broke off (no
    success mark) is made again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def optional(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The tables that exist; raises if none does."""
    out = [spark.read.parquet(p) for p in paths if exists(spark, p)]
    if not out:
        raise FileNotFoundError(f"none of {paths}")
    return out


def preferred(names: list[str], wish: str = "train") -> str:
    """The part to read: the wished one if there is one, else the first."""
    if not names:
        raise ValueError("no part to read")
    return wish if wish in names else names[0]
