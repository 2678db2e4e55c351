"""Crop calendars and biome parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube import registry


def change_points(calendar: DataFrame, default: str = registry.DEFAULT_CROP, min_days: int = 1, key: str = "sector_id") -> DataFrame:
    """(key, date, crop_name): the days on which a sector's crop changes.

    A crop begins at planting, and the default one at a harvest ``min_days`` or more
    later. On one day a planting goes before a harvest, and the later entry before
    the earlier one. A harvest before its planting is an error.
    """
    plant, harvest = F.to_date("plant_time"), F.to_date("harvest_time")
    checked = F.when(harvest < plant, F.raise_error(F.lit("harvest before planting")).cast("date")).otherwise(harvest)
    rows = calendar.select(key, "seq", "crop_name", plant.alias("_plant"), checked.alias("_harvest"))
    events = rows.select(
        key, "seq",
        F.explode(
            F.array(
                F.struct(F.col("_plant").alias("date"), F.col("crop_name").alias("crop_name"), F.lit(1).alias("planted")),
                F.struct(F.when(F.col("_plant").isNull() | (F.datediff("_harvest", "_plant") >= min_days), F.col("_harvest")).alias("date"), F.lit(default).alias("crop_name"), F.lit(0).alias("planted")),
            )
        ).alias("e"),
    ).select(key, "seq", "e.*").where("date is not null")
    order = W.partitionBy(key, "date").orderBy(F.col("planted").desc(), F.col("seq").desc())
    daily = events.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(key, "date", "crop_name")
    before = F.lag("crop_name").over(W.partitionBy(key).orderBy("date"))
    return daily.withColumn("_before", before).where("_before is null or _before <> crop_name").drop("_before")


def with_biome(crops: DataFrame, biomes: DataFrame, parameters: DataFrame, columns: Sequence[str] = ("lue_max",)) -> DataFrame:
    """Crops with their biome's parameters; both tables are small and fixed. An unknown crop has NULLs."""
    return crops.join(F.broadcast(biomes), "crop_name", "left").join(F.broadcast(parameters.select("biome", *columns)), "biome", "left")


def unknown_crops(crops: DataFrame, biomes: DataFrame) -> DataFrame:
    """Crop names without a biome, for a strict check."""
    return crops.select("crop_name").distinct().join(F.broadcast(biomes), "crop_name", "left_anti")
