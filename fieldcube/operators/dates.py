"""Calendars: missing days, runs of days, and the collapse of a day's instants."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST_DAY = "2017-01-01"


def check_range(days: Sequence[str | None] | None, today: str | None = None) -> tuple[str, str]:
    """A closed range of days; without one, from the archive's first day to today. Raises ValueError unless start <= end."""
    if not days:
        return FIRST_DAY, today or dt.datetime.now(dt.UTC).date().isoformat()
    if len(days) != 2 or None in days:
        raise ValueError("a date range has a start and an end")
    start, end = (dt.date.fromisoformat(d) for d in days)
    if start > end:
        raise ValueError(f"the range starts on {start}, after its end on {end}")
    return start.isoformat(), end.isoformat()


def split_range(start: str, end: str, today: str, threshold: int = 5) -> dict[str, tuple[str, str] | None]:
    """The archive's part, up to ``threshold`` + 1 days before today, and the forecast's part after that."""
    limit = (dt.date.fromisoformat(today) - dt.timedelta(days=threshold)).isoformat()
    before = (dt.date.fromisoformat(limit) - dt.timedelta(days=1)).isoformat()
    return {"archive": (start, min(end, before)) if start <= before else None, "forecast": (max(start, limit), end) if end >= limit else None}


def split_ranges(ranges: DataFrame, today: str, threshold: int = 5) -> DataFrame:
    """``split_range`` for rows (start, end): archive_start, archive_end, forecast_start, forecast_end, NULL where a part is empty."""
    limit = F.date_sub(F.to_date(F.lit(today)), threshold)
    before = F.date_sub(limit, 1)
    old, new = F.col("start") <= before, F.col("end") >= limit
    return ranges.select(
        "*", F.when(old, F.col("start")).alias("archive_start"), F.when(old, F.least("end", before)).alias("archive_end"),
        F.when(new, F.greatest("start", limit)).alias("forecast_start"), F.when(new, F.col("end")).alias("forecast_end"),
    )


def missing_days(have: DataFrame, keys: DataFrame, start: str, end: str, date: str = "d") -> DataFrame:
    """(keys, d): the days of the closed range that a key lacks. ``have`` has the columns of ``keys`` and the date."""
    calendar = keys.select("*", F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias(date))
    return calendar.join(have.select(*keys.columns, date).distinct(), [*keys.columns, date], "left_anti")


def islands(days: DataFrame, keys: Sequence[str], date: str = "d") -> DataFrame:
    """(keys, start, end): runs of consecutive days."""
    once = days.select(*keys, date).distinct()
    run = F.date_sub(date, F.row_number().over(W.partitionBy(*keys).orderBy(date)))
    return once.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(date).alias("start"), F.max(date).alias("end")).drop("_run")


def distinct_days(cube: DataFrame, no_data: DataFrame | None = None, keys: Sequence[str] = ("sector_id",), time: str = "time", date: str = "d") -> DataFrame:
    """Days with an acquisition and days known to have none."""
    days = cube.select(*keys, F.to_date(time).alias(date))
    return (days if no_data is None else days.unionByName(no_data.select(*keys, date))).distinct()


def same_day_midpoint(instants: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """(keys, d, time): a day's instant, or the middle of its first and last if it has several."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    by_day = instants.groupBy(*keys, F.to_date(time).alias("d")).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return by_day.select(*keys, "d", F.timestamp_micros(F.expr("(_lo + _hi) div 2")).alias(time))


def sorted_days(days: Column) -> Column:
    """An array of dates or their text, ascending, as dates."""
    return F.array_sort(F.transform(days, lambda d: F.to_date(d)))


def reconcile(acquired: DataFrame, known_days: DataFrame, keys: Sequence[str], time: str = "time", date: str = "d") -> DataFrame:
    """Each known day with its instant, or its midnight where there is none.

    An instant on a day that isn't known is kept with ``quarantined`` true instead
    of a made-up date.
    """
    a = acquired.select(*keys, F.to_date(time).alias(date), F.col(time).cast("timestamp").alias("_instant"))
    k = known_days.select(*keys, date, F.lit(True).alias("_known"))
    both = a.join(k, [*keys, date], "full")
    return both.select(*keys, date, F.coalesce("_instant", F.col(date).cast("timestamp")).alias(time), F.col("_known").isNull().alias("quarantined"))
