"""Rolling growth: the mean index one month ahead less that of the month before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000
MONTH = 30 * DAY


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def dense(cube: DataFrame, value: str, pixels: DataFrame | None = None) -> DataFrame:
    """Every pixel of a sector (or of ``pixels``) at every time of the sector; missing values NULL."""
    times = cube.select("sector_id", "time").distinct()
    pixels = cube.select("sector_id", "y", "x").distinct() if pixels is None else pixels
    return times.join(pixels, "sector_id").join(cube.select("sector_id", "time", "y", "x", value), ["sector_id", "time", "y", "x"], "left")


def rolling_growth(cube: DataFrame, value: str = "ndvi", min_obs: int = 8, pixels: DataFrame | None = None) -> DataFrame:
    """Per pixel and time t: mean over [t+30d, t+60d) less mean over [t-30d, t).

    NULL unless these windows and [t, t+30d) all hold ``min_obs`` of the sector's
    times, counted whatever the pixels have. ``pixels`` (sector_id, y, x): the pixels in
    question, if not all that the cube has.
    """
    windows = {"prev": (-MONTH, -1), "curr": (0, MONTH - 1), "next": (MONTH, 2 * MONTH - 1)}
    by_sector = W.partitionBy("sector_id").orderBy("_t")
    times = cube.select("sector_id", "time").distinct().withColumn("_t", _micros("time"))
    times = times.select("sector_id", "time", *[F.count(F.lit(1)).over(by_sector.rangeBetween(*w)).alias(f"_{n}") for n, w in windows.items()])
    enough = F.least(*[F.col(f"_{n}") for n in windows]) >= min_obs
    by_pixel = W.partitionBy("sector_id", "y", "x").orderBy("_t")
    mean = lambda n: F.avg(value).over(by_pixel.rangeBetween(*windows[n]))
    grown = dense(cube, value, pixels).withColumn("_t", _micros("time")).select("sector_id", "time", "y", "x", (mean("next") - mean("prev")).alias("_growth"))
    return grown.join(times, ["sector_id", "time"]).select("sector_id", "time", "y", "x", F.when(enough, F.col("_growth")).alias("ags"))


def spans(instants: DataFrame, before: int, after: int) -> DataFrame:
    """(sector_id, lo, hi): the union of [t - before, t + after] over a sector's instants, as runs that don't meet, in microseconds."""
    w = W.partitionBy("sector_id").orderBy("lo")
    each = instants.select("sector_id", _micros("time").alias("_t")).distinct().select("sector_id", (F.col("_t") - before).alias("lo"), (F.col("_t") + after).alias("hi"))
    far = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = each.withColumn("_new", F.coalesce(F.col("lo") > far, F.lit(True)).cast("int"))
    return runs.withColumn("_run", F.sum("_new").over(w)).groupBy("sector_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def _within(times: DataFrame, runs: DataFrame) -> DataFrame:
    """The instants (sector_id, time) in one of a sector's runs; runs and instants meet in months."""
    month = lambda c: F.floor(c / MONTH)
    by_month = runs.withColumn("_m", F.explode(F.sequence(month(F.col("lo")), month(F.col("hi")))))
    t = times.withColumn("_t", _micros("time"))
    return t.withColumn("_m", month(F.col("_t"))).join(by_month, ["sector_id", "_m"]).where("_t between lo and hi").select("sector_id", "time").distinct()


def refreshed(cube: DataFrame, cached: DataFrame, changed: DataFrame, value: str = "ndvi", min_obs: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows computed, cached rows that don't hold any more): the growth after a change, from the growth cached before.

    ``cube`` is the cube as it is now, ``changed`` the instants (sector_id, time) whose
    rows came, went or changed. An instant t counts in the results of (t - 60d, t + 30d] alone:
    these are computed from the times that their windows reach, the others still hold. A pixel
    that the cache doesn't have is computed at all of its sector's times, one that the cube lost goes. Columns of ``cached``: as of :func:`rolling_growth`.
    """
    times = cube.select("sector_id", "time").distinct()
    stale = _within(times, spans(changed, 2 * MONTH - 1, MONTH))
    reach = _within(times, spans(stale, MONTH, 2 * MONTH - 1))
    sectors = changed.select("sector_id").distinct()
    mine = cube.select("sector_id", "time", "y", "x", value)
    pixels = mine.join(sectors, "sector_id", "left_semi").select("sector_id", "y", "x").distinct()
    known = cached.join(sectors, "sector_id", "left_semi").select("sector_id", "y", "x").distinct()
    new, lost = pixels.join(known, ["sector_id", "y", "x"], "left_anti"), known.join(pixels, ["sector_id", "y", "x"], "left_anti")
    old = pixels.join(known, ["sector_id", "y", "x"], "left_semi")
    again = rolling_growth(mine.join(reach, ["sector_id", "time"], "left_semi"), value, min_obs, old).join(stale, ["sector_id", "time"], "left_semi")
    first = rolling_growth(mine.join(new.select("sector_id").distinct(), "sector_id", "left_semi"), value, min_obs, new)
    gone = changed.select("sector_id", "time").unionByName(stale).distinct()  # a changed instant may be no time of the cube any more
    old_rows = cached.join(gone, ["sector_id", "time"], "left_semi").unionByName(cached.join(gone, ["sector_id", "time"], "left_anti").join(lost, ["sector_id", "y", "x"], "left_semi"))
    return again.unionByName(first), old_rows.select("sector_id", "time", "y", "x")
