"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hindcast.streaming.bars import folder


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows written to the shared folder and read back, for what several branches of a plan read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
