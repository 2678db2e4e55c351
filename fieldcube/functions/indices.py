"""Vegetation and stress indices as column expressions; a zero denominator gives NULL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def contrast(a: str, b: str) -> Column:
    """Normalised difference of two bands."""
    return ratio(F.col(a) - F.col(b), F.col(a) + F.col(b))


def _arvi() -> Column:
    part = 0.106 * (F.col("b04") - F.col("b02"))
    return ratio(F.col("b8a") - F.col("b04") - part, F.col("b8a") + F.col("b04") - part)


#: Name -> expression over band columns. ``msi`` is the near-infrared contrast that the service computes under this name.
RULES: dict[str, Callable[[], Column]] = {
    "savi": lambda: ratio(F.col("b08") - F.col("b04"), F.col("b08") + F.col("b04") + 0.5),
    "ndvi": lambda: contrast("b08", "b04"),
    "evi": lambda: ratio(2.5 * (F.col("b08") - F.col("b04")), F.col("b08") + 6.0 * F.col("b04") - 7.5 * F.col("b02") + 1.0),
    "evi2": lambda: ratio(2.4 * (F.col("b08") - F.col("b04")), F.col("b08") + F.col("b04") + 1.0),
    "gndvi": lambda: contrast("b08", "b03"),
    "msi": lambda: contrast("b08", "b04"),
    "ndmi": lambda: contrast("b08", "b11"),
    "nbr": lambda: contrast("b08", "b12"),
    "psri": lambda: ratio(F.col("b04") - F.col("b02"), F.col("b06")),
    "ari": lambda: ratio(F.lit(1.0), F.col("b03")) - ratio(F.lit(1.0), F.col("b05")),
    "arvi": _arvi,
    "sipi": lambda: ratio(F.col("b08") - F.col("b02"), F.col("b08") - F.col("b04")),
    "ndyi": lambda: contrast("b03", "b02"),
}


def composites(bands: DataFrame, names: Sequence[str] = tuple(RULES), keys: Sequence[str] = ("sector_id", "time", "y", "x")) -> DataFrame:
    """Any number of indices in one projection."""
    return bands.select(*keys, *[RULES[n]().alias(n) for n in names])
