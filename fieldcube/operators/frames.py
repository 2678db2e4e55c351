"""Joins and reshaping of plain tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, on average.
BLOCK = 1024


def blocks(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name, name_block): each key's rows in arrays of about ``BLOCK``: the other columns as ``row``, and how ``many`` rows are equal. Rows with a NULL key are left out."""
    once = df.dropna(subset=list(keys)).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    parts = once.groupBy(*keys).agg(F.ceil(F.sum("_n") / BLOCK).alias("_parts"))
    rows = once.join(parts, list(keys)).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {BLOCK}"))))
    row = F.struct(F.struct(*[c for c in df.columns if c not in keys], F.lit(0).alias("_")).alias("row"), F.least(F.lit(BLOCK), F.col("_n") - F.col("_k") * BLOCK).cast("int").alias("many"))
    return rows.groupBy(*keys, F.pmod(F.xxhash64(*df.columns, "_k"), F.col("_parts")).alias(f"{name}_block")).agg(F.collect_list(row).alias(name))


def paired(met: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, a, b): all pairs of rows of the two blocks (see :func:`blocks`) in each row, which are spread over all tasks first.

    Rows of ``a`` are taken one by one by the expression that expands the block: expanded beforehand, both loops would be compiled into one, which holds a whole block pair's rows.
    """
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lambda c: F.flatten(F.transform(c, lambda r: F.array_repeat(r["row"], r["many"])))
    spread = met.repartition(n, *keys, f"{a}_block", f"{b}_block").withColumn(b, rows(b))
    return spread.select(*keys, F.explode(rows(a)).alias(a), b).select(*keys, a, F.explode(b).alias(b))


def merge(old: DataFrame | None, new: DataFrame | None, how: str = "merge") -> DataFrame | None:
    """Natural inner join ("merge") or union by name ("concat"); nothing on one side gives the other.

    The join goes by blocks of a key's rows, so that few keys with many rows on both sides spread.
    """
    if old is None or new is None:
        return new if old is None else old
    if how == "concat":
        return old.unionByName(new, allowMissingColumns=True)
    if how != "merge":
        raise ValueError(f"unknown way to merge: {how}")
    keys = [c for c in old.columns if c in new.columns]
    if not keys:
        return old.crossJoin(new)
    pairs = paired(blocks(old, keys, "_old").join(blocks(new, keys, "_new"), keys), keys, "_old", "_new")
    return pairs.select(*keys, *[F.col(side)[c].alias(c) for side, df in (("_old", old), ("_new", new)) for c in df.columns if c not in keys])


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the common columns."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def soil_chain(geo: DataFrame, info: DataFrame, legend: DataFrame, drop: Sequence[str] = ("BF_ID", "TKLE_NR")) -> DataFrame:
    """Soil polygons with their attributes and legend, the join ids dropped."""
    return natural_left(natural_left(geo, info), legend).drop(*drop)


def join_cubes(cubes: Sequence[DataFrame], keys: Sequence[str] = ("sector_id", "time", "y", "x")) -> DataFrame:
    """Products side by side, for pixels and times that all have."""
    return reduce(lambda a, b: a.join(b, list(keys)), cubes)


def merge_bands(layers: Mapping[str, DataFrame], keys: Sequence[str] = ("sector_id", "time", "y", "x")) -> DataFrame:
    """Single-band tables of one grid as one wide table: a union and one aggregation instead of a join per band."""
    wide = [df.select(*keys, *[(F.col("value") if n == name else F.lit(None).cast("double")).alias(n) for n in layers]) for name, df in layers.items()]
    return reduce(DataFrame.unionByName, wide).groupBy(*keys).agg(*[F.max(n).alias(n) for n in layers])


def sorted_columns(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def one_hot(df: DataFrame, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for each distinct value, in order, then the other columns.

    The values of an encoded column name columns; more than ``most`` are an error.
    """
    out = []
    for c in columns:
        values = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} values")
        out += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{re.sub('[^0-9A-Za-z]+', '_', str(v))}") for v in values]
    return df.select(*out, *[c for c in df.columns if c not in columns])


def flat_frames(cubes: Sequence[DataFrame], weather_daily: DataFrame | None, background: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Pixel, weather and background tables over all sectors; times named date, without time zone."""
    pixels = join_cubes(cubes).withColumnRenamed("time", "date") if cubes else None
    weather = weather_daily.withColumn("date", F.col("date").cast("timestamp_ntz")) if weather_daily is not None else None
    return pixels, weather, background
