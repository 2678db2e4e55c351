"""Weather tables: wide and long, completeness, and the gaps to fetch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcube.operators import dates
from fieldcube.operators.cube import first_by_key


def widen(long: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("sector_id", "date")) -> DataFrame:
    """One column per variable; named ones only, so no extra pass finds the values."""
    return long.groupBy(*keys).agg(*[F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])


def lengthen(wide: DataFrame, keys: Sequence[str] = ("sector_id", "date")) -> DataFrame:
    """(keys, variable, value), missing values left out."""
    variables = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), variables, "variable", "value").where("value is not null")


def complete_days(frame: DataFrame, required: Sequence[str], keys: Sequence[str] = ("sector_id",), date: str = "date") -> DataFrame:
    """(keys, d): days with a row on which all required columns have a value; none if a column is missing."""
    if any(c not in frame.columns for c in required):
        return frame.select(*keys, F.to_date(date).alias("d")).where("false")
    return frame.dropna(how="any", subset=list(required)).select(*keys, F.to_date(date).alias("d")).distinct()


def common_complete_days(frames: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]], keys: Sequence[str] = ("sector_id",)) -> DataFrame:
    """Days that are complete in every asked frame."""
    return reduce(DataFrame.intersect, [complete_days(frames[n], columns, keys) for n, columns in required.items()])


def gaps(frames: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]], sectors: DataFrame, start: str, end: str) -> DataFrame:
    """(sector_id, start, end): the ranges of days to fetch. A frame without cached rows makes all days missing."""
    keys = sectors.select("sector_id").distinct()
    return dates.islands(dates.missing_days(common_complete_days(frames, required), keys, start, end), ["sector_id"])


def sync(cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], gaps_: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The long cache with what ``fetch`` gives for the gaps, the cached value first; of the range, or all of it."""
    both = cache.withColumn("_age", F.lit(0)).unionByName(fetch(gaps_).select(*cache.columns).withColumn("_age", F.lit(1)))
    rows = first_by_key(both, ["sector_id", "date", "variable"], [F.col("_age"), F.col("value")]).drop("_age")
    if start is not None:
        rows = rows.where(F.to_date("date") >= F.to_date(F.lit(start)))
    return rows if end is None else rows.where(F.to_date("date") <= F.to_date(F.lit(end)))


def time_grid(responses: DataFrame) -> DataFrame:
    """(sector_id, date, variable, value) of API responses (sector_id, start, end, interval in seconds, variables: map to arrays).

    The grid is closed on the left: the end itself isn't in it.
    """
    n = F.expr("(end - start) div interval")
    rows = responses.where(n > 0).select("sector_id", "start", "interval", n.alias("_n"), F.explode("variables").alias("variable", "_values"))
    rows = rows.select("sector_id", "start", "interval", "variable", "_n", F.posexplode("_values").alias("_i", "value")).where("_i < _n")
    return rows.select("sector_id", F.timestamp_seconds(F.col("start") + F.col("_i") * F.col("interval")).alias("date"), "variable", F.col("value").cast("double").alias("value"))


def par_series(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(sector_id, date, par) of JSON answers with a map of yyyyMMdd to a number."""
    kind = "properties struct<parameter: struct<ALLSKY_SFC_PAR_TOT: map<string, double>>>"
    days = payloads.select("sector_id", F.explode(F.from_json(column, kind)["properties"]["parameter"]["ALLSKY_SFC_PAR_TOT"]).alias("_d", "par"))
    return days.select("sector_id", F.to_date("_d", "yyyyMMdd").alias("date"), "par")
