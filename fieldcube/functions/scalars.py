"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roof(x: Column) -> Column:
    """The whole number itself, else the truncated one plus 1 (so -1.5 gives 0)."""
    whole = x.cast("long")
    return F.when(x == whole, whole).otherwise(whole + 1)


def flatten_list(x: Column) -> Column:
    """One level of nesting less."""
    return F.flatten(x)


def local_path(path: Column, base: str = "/data", local: str = "files") -> Column:
    """A path with the service's base folder replaced."""
    return F.replace(path, F.lit(base), F.lit(local))


def tiff_name(variable: Column, time: Column) -> Column:
    """variable_timestamp.tiff with colons as dashes."""
    return F.concat(variable, F.lit("_"), F.replace(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(":"), F.lit("-")), F.lit(".tiff"))


def nodata_as_zero(value: Column, limit: float = -9999.0) -> Column:
    return F.when(value <= limit, 0.0).otherwise(value)


def nan_as_null(df: DataFrame) -> DataFrame:
    """Every NaN of a floating column as NULL, which aggregates pass over."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def image_size(lon_diff: Column, lat_diff: Column, max_size: int) -> tuple[Column, Column]:
    """(width, height) of an image of a box, its longer side max_size."""
    wide = lon_diff >= lat_diff
    return F.when(wide, max_size).otherwise(F.floor(lon_diff * max_size / lat_diff)), F.when(wide, F.floor(lat_diff * max_size / lon_diff)).otherwise(max_size)
