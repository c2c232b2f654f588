"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name` of a folder; `columns` prunes the scan."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
