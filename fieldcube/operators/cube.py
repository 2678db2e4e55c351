"""Raster time series as long tables: one row per sector, time, y, x."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["sector_id", "time", "y", "x"]


def values_of(cube: DataFrame) -> list[str]:
    return [c for c in cube.columns if c not in KEYS]


def full(cube: DataFrame) -> DataFrame:
    return cube


def spatial_mean(cube: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Per sector and time the mean of each value over all pixels, missing ones left out."""
    return cube.groupBy("sector_id", "time").agg(*[F.avg(v).alias(v) for v in values or values_of(cube)])


def temporal_mean(cube: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """Per pixel the mean of each value over time."""
    return cube.groupBy("sector_id", "y", "x").agg(*[F.avg(v).alias(v) for v in values or values_of(cube)])


MODES = {"full": full, "spatial_mean": spatial_mean, "temporal_mean": temporal_mean}


def summaries(cube: DataFrame, modes: Sequence[str]) -> dict[str, DataFrame]:
    """The asked modes; unknown names are left out."""
    return {m: MODES[m](cube) for m in modes if m in MODES}


def time_slice(cube: DataFrame, start: str | None, end: str | None, column: str = "time") -> DataFrame:
    """Rows from the first day to the last day, both whole. The bounds are on the stored column, so that they reach the scan."""
    t = F.col(column)
    if start is not None:
        cube = cube.where(t >= F.to_timestamp(F.lit(start)))
    if end is not None:
        cube = cube.where(t < F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1)))
    return cube


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def append_means(cube: DataFrame, values: Sequence[str]) -> DataFrame:
    """Beside each value its mean over the sector at that time, as ``<value>_mean``."""
    means = cube.groupBy("sector_id", "time").agg(*[F.avg(v).alias(f"{v}_mean") for v in values]).withColumnsRenamed({"sector_id": "_s", "time": "_t"})
    return cube.join(means, F.col("sector_id").eqNullSafe(F.col("_s")) & F.col("time").eqNullSafe(F.col("_t")), "left").drop("_s", "_t")


def frame_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the mean of each column."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def sector_slice(sectors: DataFrame, start: int, end: int, order: Sequence[str] = ("farm_id", "sector_id")) -> DataFrame:
    """Sectors start..end-1 in the given order."""
    return sectors.orderBy(*order).offset(start).limit(max(0, end - start))
