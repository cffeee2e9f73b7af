"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table by name; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
