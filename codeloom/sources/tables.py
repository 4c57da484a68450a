"""Readers for the driver tables (one Parquet path per table below a folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
