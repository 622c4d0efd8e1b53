"""Scaling of each feature across samples: one window over row_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscore(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.try_divide(F.col("value") - F.avg(F.col("value")).over(Window.partitionBy("row_id")), F.stddev_pop(F.col("value")).over(Window.partitionBy("row_id"))))


def minmax(cells: DataFrame) -> DataFrame:
    low, high = F.min(F.col("value")).over(Window.partitionBy("row_id")), F.max(F.col("value")).over(Window.partitionBy("row_id"))
    return cells.withColumn("value", F.try_divide(F.col("value") - low, high - low))


def absmax(cells: DataFrame, signed: bool = False) -> DataFrame:
    """By the largest absolute value, so that values lie in [-1, 1]; signed: by the largest value."""
    return cells.withColumn("value", F.try_divide(F.col("value"), F.max(F.col("value") if signed else F.abs(F.col("value"))).over(Window.partitionBy("row_id"))))


def standard(cells: DataFrame) -> DataFrame:
    """As zscore, but a feature without variance is divided by one."""
    sd = F.stddev_pop(F.col("value")).over(Window.partitionBy("row_id"))
    return cells.withColumn("value", (F.col("value") - F.avg(F.col("value")).over(Window.partitionBy("row_id"))) / F.when(sd > 0, sd).otherwise(1.0))


SCALERS = {"zscore": zscore, "minmax": minmax, "absmax": absmax, "standard": standard}


def scale(cells: DataFrame, method: str) -> DataFrame:
    if method not in SCALERS:
        raise ValueError(f"unknown scaling method {method!r}; known: {', '.join(SCALERS)}")
    return SCALERS[method](cells)
