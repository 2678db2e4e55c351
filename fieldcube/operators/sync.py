"""Caches of cubes: upsert, merge, and what is known to be empty."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.operators import dates

TOLERANCE = 1e-10


def upsert(old: DataFrame, new: DataFrame, prefer: str = "new", keys: Sequence[str] = ("sector_id", "time")) -> DataFrame:
    """Both tables' rows; where both have a key, all rows of the preferred one.

    An anti join on the keys alone: the preferred rows pass straight through.
    """
    if prefer not in ("new", "old"):
        raise ValueError(f"prefer is new or old, not {prefer}")
    first, second = (new, old) if prefer == "new" else (old, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def grid_of(cube: DataFrame) -> DataFrame:
    """(sector_id, n_x, n_y): each sector's number of columns and rows."""
    return cube.groupBy("sector_id").agg(F.countDistinct("x").alias("n_x"), F.countDistinct("y").alias("n_y"))


def not_contained(small: DataFrame, large: DataFrame, value: str) -> DataFrame:
    """Rows of ``small`` that ``large`` lacks or has with another value, within the tolerance."""
    near = lambda c: F.round(F.col(c) / TOLERANCE).cast("decimal(38,0)")
    keyed = lambda df: df.withColumn("_y", near("y")).withColumn("_x", near("x"))
    other = keyed(large).select("sector_id", "time", "_y", "_x", F.col(value).alias("_other"), F.lit(True).alias("_there"))
    joined = keyed(small).join(other, ["sector_id", "time", "_y", "_x"], "left")
    same = F.col(value).eqNullSafe(F.col("_other")) | (F.abs(F.col(value) - F.col("_other")) <= TOLERANCE)
    return joined.where(F.col("_there").isNull() | ~F.coalesce(same, F.lit(False))).select(*small.columns)


def is_subset(small: DataFrame, large: DataFrame, value: str) -> bool:
    return not_contained(small, large, value).isEmpty()


def regrid_nearest(cube: DataFrame, grid: DataFrame) -> DataFrame:
    """Values on the grid (sector_id, y, x): for each axis the nearest own coordinate, the smaller in a tie.

    Coordinates of an axis are few; each axis is matched by its own small table.
    """

    def nearest(axis: str) -> DataFrame:
        own = cube.select("sector_id", F.col(axis).alias("_at"), F.lit(0).alias("_grid")).distinct()
        to = grid.select("sector_id", F.col(axis).alias("_at"), F.lit(1).alias("_grid")).distinct()
        w = W.partitionBy("sector_id").orderBy("_at", "_grid")
        mine = F.when(F.col("_grid") == 0, F.col("_at"))
        both = own.unionByName(to).select("*", F.last(mine, True).over(w).alias("_lo"), F.first(mine, True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("_hi"))
        pick = F.when(F.col("_hi").isNull() | (F.col("_at") - F.col("_lo") <= F.col("_hi") - F.col("_at")), F.coalesce("_lo", "_hi")).otherwise(F.col("_hi"))
        return both.where("_grid = 1").select("sector_id", F.col("_at").alias(f"new_{axis}"), pick.alias(axis))

    values = [c for c in cube.columns if c not in ("sector_id", "time", "y", "x")]
    moved = cube.join(nearest("x"), ["sector_id", "x"]).join(nearest("y"), ["sector_id", "y"])
    return moved.select("sector_id", "time", F.col("new_y").alias("y"), F.col("new_x").alias("x"), *values)


def sync_cube(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """The cache after new rows: unchanged if they are in it already, else new ones win.

    Grids that differ by no more than a tenth of an axis and one are matched by the
    nearest cell; others are an error.
    """
    if new.isEmpty():
        raise ValueError("the new cube has no columns")
    if is_subset(new, old, value):
        return old
    a, b = grid_of(old), grid_of(new).withColumnsRenamed({"n_x": "m_x", "n_y": "m_y"})
    off = lambda p, q: F.abs(F.col(p) - F.col(q)) > F.floor(F.greatest(p, q) / 10) + 1
    both = a.join(b, "sector_id")
    if not both.where(off("n_x", "m_x") | off("n_y", "m_y")).isEmpty():
        raise ValueError("the grids differ too much")
    if not both.where("n_x <> m_x or n_y <> m_y").isEmpty():
        new = regrid_nearest(new, old.select("sector_id", "y", "x").distinct())
    return upsert(old, new, "new")


def spatial_merge(a: DataFrame, b: DataFrame, values: Sequence[str], keys: Sequence[str] = ("sector_id", "time", "y", "x")) -> DataFrame:
    """Tiles side by side; where both have a cell, the first's value if it has one."""
    left, right = a.select(*keys, *values), b.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return left.join(right, list(keys), "full").select(*keys, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def record_no_data(known: DataFrame, more: DataFrame) -> DataFrame:
    """(sector_id, product, d): all days known to be empty; none at all is fine."""
    return known.unionByName(more).distinct()


def copy_no_data(known: DataFrame, source: str, target: str) -> DataFrame:
    """The empty days of one product also for another one."""
    return record_no_data(known, known.where(F.col("product") == source).withColumn("product", F.lit(target)))


def sync_union(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    """Union by name; nothing on one side gives the other."""
    if a is None or b is None:
        return b if a is None else a
    return a.unionByName(b, allowMissingColumns=True)


def ingest(cache: DataFrame, arrived: DataFrame, keys: Sequence[str] = ("sector_id", "time")) -> tuple[DataFrame, DataFrame]:
    """(cache, quarantine): rows with an ``_error`` go aside, of the others the cached ones win."""
    good, bad = arrived.where("_error is null").drop("_error"), arrived.where("_error is not null")
    return upsert(cache, good, "old", keys), bad


def sync_product(cache: DataFrame, no_data: DataFrame, sectors: DataFrame, start: str, end: str, fetch: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None, product: str) -> tuple[DataFrame, DataFrame]:
    """(cache of the range, no_data) after the missing ranges were fetched; without ``fetch`` nothing is.

    ``fetch`` takes (sector_id, start, end) and returns the rows and the empty days
    it met. Days known to be empty are never asked for again.
    """
    if fetch is not None:
        have = dates.distinct_days(cache, no_data.where(F.col("product") == product))
        wanted = dates.islands(dates.missing_days(have, sectors.select("sector_id").distinct(), start, end), ["sector_id"])
        rows, empty = fetch(wanted)
        cache, no_data = upsert(cache, rows, "new"), record_no_data(no_data, empty)
    days = F.to_date("time")
    return cache.where(days.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))), no_data
