"""Gross primary production: fAPAR x PAR x light-use efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcube import registry
from fieldcube.operators import crops, cube, temporal


def daily_efficiency(fapar: DataFrame, calendar: DataFrame, biomes: DataFrame, parameters: DataFrame, min_days: int = registry.MIN_CROP_DAYS) -> DataFrame:
    """(sector_id, date, lue_max) for the cube's days: the crop at that day, as of its change points."""
    changes = crops.with_biome(crops.change_points(calendar, min_days=min_days), biomes, parameters).select("sector_id", "date", "lue_max")
    days = fapar.select("sector_id", F.to_date("time").alias("date")).distinct()
    return temporal.as_of(days, changes, ["sector_id"], ["lue_max"])


def daily_radiation(fapar: DataFrame, par: DataFrame) -> DataFrame:
    """(sector_id, date, par) for the cube's days, as of the series."""
    days = fapar.select("sector_id", F.to_date("time").alias("date")).distinct()
    return temporal.as_of(days, par.select("sector_id", "date", "par"), ["sector_id"], ["par"])


def gpp(fapar: DataFrame, par: DataFrame, calendar: DataFrame, biomes: DataFrame, parameters: DataFrame, *, interpolation: str | None = None, min_days: int = registry.MIN_CROP_DAYS) -> DataFrame:
    """(sector_id, time, y, x, gpp). Days before a sector's first crop or radiation value give NULL.

    Both factors are looked up per sector and day, not per pixel, and meet the
    pixels in one join.
    """
    if interpolation:
        fapar = temporal.interpolate_daily(fapar, ["sector_id", "y", "x"], "fapar", interpolation)
    factors = daily_efficiency(fapar, calendar, biomes, parameters, min_days).join(daily_radiation(fapar, par), ["sector_id", "date"])
    factors = factors.select("sector_id", "date", (F.col("lue_max") * F.col("par")).alias("factor"))
    return temporal.multiply_by_day(fapar.select("sector_id", "time", "y", "x", F.col("fapar").alias("gpp")), factors, ["gpp"], "factor", keys=["sector_id"])


def summaries(product: DataFrame, modes: list[str]) -> dict[str, DataFrame]:
    """GPP in the asked modes."""
    return cube.summaries(product, modes)
