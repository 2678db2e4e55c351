"""Background of a sector: soil attributes and raster means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcube.functions import geometry as g
from fieldcube.functions.scalars import nodata_as_zero
from fieldcube.operators import frames, spatial


def layer_means(rasters: DataFrame, ring: Sequence[g.Point] | None = None, zero_nodata: bool = True) -> DataFrame:
    """(sector_id, one column per layer in long form: layer, value): means over the cells in a ring, no data as zero if asked."""
    rows = rasters if ring is None else spatial.mask(rasters, ring, ["value"]).where("value is not null")
    value = nodata_as_zero(F.col("value")) if zero_nodata else F.when(F.col("value") > -9999, F.col("value"))
    return rows.groupBy("sector_id", "layer").agg(F.avg(value).alias("value"))


def background(sectors: DataFrame, soil: tuple[DataFrame, DataFrame, DataFrame], rasters: DataFrame, layers: Sequence[str], cell: float = 0.01, ring: Sequence[g.Point] | None = None) -> DataFrame:
    """(sector_id, soil attributes, one column per layer). Sectors and soil polygons meet where they have a point in common; rasters count in ``ring``, if there is one."""
    geo, info, legend = soil
    met = spatial.intersecting(sectors.select(F.col("sector_id").alias("id"), "ring"), geo.select("area_id", "ring"), cell)
    attributes = frames.soil_chain(geo.drop("ring"), info, legend).join(met, "area_id").withColumnRenamed("id", "sector_id")
    means = layer_means(rasters, ring).groupBy("sector_id").agg(*[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in layers])
    return attributes.join(means, "sector_id", "left")
