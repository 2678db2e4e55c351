"""Daily interpolation and as-of alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.operators.growth import DAY

#: Values of a series that are solved together, and those on either side that count too.
CHUNK, HALO = 4096, 64
#: Series that are solved at once.
BLOCK = 256


def interpolate_daily(df: DataFrame, keys: Sequence[str], value: str, method: str = "linear", time: str = "time", grid: Sequence[str] = ("sector_id",)) -> DataFrame:
    """(keys, time, value) on a grid of days from each ``grid`` key's first instant to its last.

    Methods: linear; nearest (the earlier value in a tie); cubic (not-a-knot, through
    the values that there are). With each, a segment with a NULL at either end gives
    NULL, a grid point on an instant that instant's own value.
    """
    if method == "cubic":
        return _cubic(df, keys, value, time, grid)
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method}")
    t = F.unix_micros(F.col(time).cast("timestamp"))
    own = W.partitionBy(*keys).orderBy("_t")
    rows = df.select(*keys, t.alias("_t"), F.col(value).alias("_v"))
    rows = _with_start(rows, [k for k in grid if k in keys])
    rows = rows.select(*keys, "_start", F.col("_t").alias("_t0"), F.col("_v").alias("_v0"), F.lead("_t").over(own).alias("_t1"), F.lead("_v").over(own).alias("_v1"))
    up = lambda x: F.floor((x - F.col("_start") + (DAY - 1)) / DAY)
    first, last = up(F.col("_t0")), F.when(F.col("_t1").isNull(), F.floor((F.col("_t0") - F.col("_start")) / DAY)).otherwise(up(F.col("_t1")) - 1)
    days = rows.select("*", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array())).alias("_k"))
    at = F.col("_start") + F.col("_k") * DAY
    part = (at - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part if method == "linear" else F.when(F.col("_v0").isNotNull() & F.col("_v1").isNotNull(), F.when(part <= 0.5, F.col("_v0")).otherwise(F.col("_v1")))
    return days.select(*keys, F.timestamp_micros(at).alias(time), F.when(at == F.col("_t0"), F.col("_v0")).otherwise(between).alias(value))


def _with_start(rows: DataFrame, grid: Sequence[str]) -> DataFrame:
    """``rows`` with _start, the first _t of their grid; rows without a grid key that is there have none."""
    starts = rows.groupBy(*grid, F.lit(0).alias("_one")).agg(F.min("_t").alias("_start"))
    return rows.withColumn("_one", F.lit(0)).join(starts, [*grid, "_one"]).drop("_one")


def _cubic(df: DataFrame, keys: Sequence[str], value: str, time: str, grid: Sequence[str]) -> DataFrame:
    """Not-a-knot cubic spline; fewer than four values fall back to the polynomial through them.

    A series is solved in chunks of ``CHUNK`` values with ``HALO`` more on either side.
    A value's influence on the second derivatives at least halves with each knot, so
    that what lies beyond the halo is below the rounding of doubles. About ``BLOCK`` series
    are solved together, each elimination step for all of them at once, whatever their instants; so a group holds
    BLOCK * CHUNK values at most, and the calls of Python grow with the blocks. Values are numbered by one window by key.
    """
    schema = f"{', '.join(f'{k} {dict(df.dtypes)[k]}' for k in keys)}, {time} timestamp, {value} double"
    own = W.partitionBy(*keys)
    rows = df.select(*keys, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null")
    rows = _with_start(rows.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v"))), [k for k in grid if k in keys])
    blocks = -(-df.select(*keys).distinct().count() // BLOCK)
    before = F.count("_v").over(own.orderBy("_t").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select(*keys, "_t", "_v", before.alias("_i"), "_start", F.count("_v").over(own).alias("_n"), F.min("_t").over(own).alias("_lo"), F.max("_t").over(own).alias("_hi"))
    chunk = lambda i: F.floor(F.greatest(i, F.lit(0)) / CHUNK)
    near = F.sequence(chunk(F.least(F.col("_i"), F.col("_n") - 1) - HALO), chunk(F.least(F.col("_i") + HALO, F.col("_n") - 1)))
    rows = rows.withColumn("_chunk", F.explode(near)).withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))

    size = CHUNK

    def spline(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.assign(_series=group.groupby(list(keys), dropna=False, sort=False).ngroup()).sort_values(["_series", "_t"], kind="stable")
        return _solved(rows, list(keys), time, value, size)

    return rows.groupBy("_block", "_chunk").applyInPandas(spline, schema)


def _solved(rows: pd.DataFrame, keys: list[str], time: str, value: str, chunk: int) -> pd.DataFrame:
    """The days of one chunk of some series (rows by _series and _t), NULL where a neighbour is."""
    series, t, v, i = (rows[c].to_numpy() for c in ("_series", "_t", "_v", "_i"))
    v = v.astype(float)
    heads = rows.drop_duplicates("_series")
    n, start, lo = heads["_n"].to_numpy(), heads["_start"].to_numpy(), int(heads["_chunk"].iloc[0]) * chunk
    p, there = len(heads), ~np.isnan(v)
    mine, x, y = series[there], t[there], v[there]
    counts = np.bincount(mine, minlength=p)
    at = np.arange(len(mine)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = max(int(counts.max(initial=0)), 1)
    xs, ys, index = np.zeros((p, width)), np.zeros((p, width)), np.full((p, width), -1)
    xs[mine, at], ys[mine, at], index[mine, at] = (x - start[mine]) / DAY, y, i[there]
    # the days of a series in this chunk: from its first value here to the next chunk's, and to the ends of the series
    inside = (index >= lo) & (index < lo + chunk)
    any_ = inside.any(1)
    first, after = inside.argmax(1), inside.argmax(1) + inside.sum(1)
    begin = np.where(any_ & (lo > 0), np.ceil(xs[np.arange(p), first]), np.ceil((heads["_lo"].to_numpy() - start) / DAY)).astype(int)
    ended = after >= counts
    end = np.where(ended, np.floor((heads["_hi"].to_numpy() - start) / DAY) + 1, np.ceil(xs[np.arange(p), np.minimum(after, width - 1)])).astype(int)
    length = np.where(any_ | (n == 0), np.maximum(end - begin, 0), 0)
    of = np.repeat(np.arange(p), length)
    days = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + begin[of]
    out = not_a_knot(xs, ys, counts, of, days.astype(float), index[:, 0] == 0, index[np.arange(p), np.maximum(counts - 1, 0)] == n - 1)
    # a day counts if it has a value of its own or values on both sides, no NULL between
    wide = int(t.max() - t.min()) + DAY + 1 if len(t) else 1
    line, moment = series * wide + (t - t.min()), start[of] + days * DAY
    k = np.searchsorted(line, of * wide + np.clip(moment - t.min(), -1, wide - 1), "right") - 1
    left = np.where((k >= 0) & (series[k] == of), k, -1)
    right = np.minimum(k + 1, len(t) - 1)
    exact = (left >= 0) & (t[left] == moment)
    known = np.where(exact, there[left], (left >= 0) & there[left] & (series[right] == of) & (right == k + 1) & there[right])
    found = heads.iloc[of][keys].reset_index(drop=True)
    found[time] = pd.to_datetime(moment, unit="us")
    found[value] = pd.array(np.where(known, out, 0.0), "Float64")
    found.loc[~known, value] = pd.NA
    return found


def not_a_knot(x: np.ndarray, y: np.ndarray, n: np.ndarray, of: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Values at places ``at`` of the series ``of`` by not-a-knot cubic splines through rows of (x, y), each with its own number n of points.

    An end that isn't the series' ``first`` or ``last`` has no curvature. Fewer than
    four points: the polynomial through them; none: 0.
    """
    p, width = x.shape
    rows, used = np.arange(p), np.arange(width) < n[:, None]
    far = np.where(used, x, np.where(n > 0, x[rows, np.maximum(n - 1, 0)], 0.0)[:, None] + np.arange(width) - n[:, None] + 1.0)  # points beyond the end, a day apart
    width = max(width, 4)
    far = np.concatenate([far, far[:, -1:] + np.arange(1, width - far.shape[1] + 1)], 1) if far.shape[1] < width else far
    ys = np.zeros((p, width))
    ys[:, : y.shape[1]] = np.where(used, y, 0.0)
    h = np.diff(far, axis=1)
    d = np.diff(ys, axis=1) / h
    m = np.zeros((p, width))
    inner = (np.arange(1, width - 1) < (n - 1)[:, None]) & (n >= 4)[:, None]
    low, mid, high = np.where(inner, h[:, :-1], 0.0), np.where(inner, 2 * (h[:, :-1] + h[:, 1:]), 1.0), np.where(inner, h[:, 1:], 0.0)
    b = np.where(inner, 6 * np.diff(d, axis=1), 0.0)
    a = rows[first & (n >= 4)]  # the end's equation put into its neighbour's
    mid[a, 0] += h[a, 0] * (h[a, 0] + h[a, 1]) / h[a, 1]
    high[a, 0] = h[a, 1] - h[a, 0] ** 2 / h[a, 1]
    z = rows[last & (n >= 4)]
    e = n[z] - 3  # the last equation of each
    mid[z, e] += h[z, e + 1] * (h[z, e + 1] + h[z, e]) / h[z, e]
    low[z, e] = h[z, e] - h[z, e + 1] ** 2 / h[z, e]
    high[rows[n >= 4], n[n >= 4] - 3] = 0.0
    low[:, 0] = 0.0
    m[:, 1:-1] = tridiagonal(low, mid, high, b)
    m[a, 0] = ((h[a, 0] + h[a, 1]) * m[a, 1] - h[a, 0] * m[a, 2]) / h[a, 1]
    m[z, e + 2] = ((h[z, e + 1] + h[z, e]) * m[z, e + 1] - h[z, e + 1] * m[z, e]) / h[z, e]
    span = float(max(np.abs(far).max(initial=0.0), np.abs(at).max(initial=0.0))) * 2 + 2
    line = (far + rows[:, None] * 2 * span).ravel()
    i = np.searchsorted(line, at + of * 2 * span, "right") - 1 - of * width
    i = np.clip(i, 0, np.maximum(n[of] - 2, 0))
    s = at - far[of, i]
    cubic = ys[of, i] + s * (d[of, i] - h[of, i] * (2 * m[of, i] + m[of, i + 1]) / 6 + s * (m[of, i] / 2 + s * (m[of, i + 1] - m[of, i]) / (6 * h[of, i])))
    few, s0, s1 = n[of], at - far[of, 0], at - far[of, 1]
    line_ = ys[of, 0] + np.where(few > 1, s0 * d[of, 0], 0.0)
    curve = np.where(few > 2, s0 * s1 * (d[of, 1] - d[of, 0]) / (far[of, 2] - far[of, 0]), 0.0)
    return np.where(few >= 4, cubic, line_ + curve)


def tridiagonal(low: np.ndarray, mid: np.ndarray, high: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solutions of systems (one a row) of three diagonals with a dominant one; the first of ``low`` and the last of ``high`` don't count."""
    mid, out = mid.T.copy(), b.T.copy()
    low, high = low.T, high.T
    for i in range(1, len(out)):
        w = low[i] / mid[i - 1]
        mid[i] -= w * high[i - 1]
        out[i] -= w * out[i - 1]
    out[-1] /= mid[-1]
    for i in range(len(out) - 2, -1, -1):
        out[i] = (out[i] - high[i] * out[i + 1]) / mid[i]
    return out.T


def as_of(targets: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = "date", days: int = 32) -> DataFrame:
    """``targets`` with the values of the last ``source`` row of its key up to its date, NULL if there is none.

    Rows of a key are dealt by spans of ``days`` days, so that a key with many rows
    spreads. A first pass finds each span's last source row, which is carried to the
    later spans of its key (one row each); a second finds the last row within the span or,
    before its first, what was carried there. No range join; every target row gives one row. Rows without a date come before all others.
    Of source rows with equal key and date any one with values may count, so make them unique.
    """
    others = [c for c in targets.columns if c not in (*keys, date)]
    span = F.coalesce(F.floor(F.unix_date(F.to_date(F.col(date))) / days), F.lit(-(2**40)).cast("long")).alias("_span")
    row = F.struct(*[F.col(v) for v in values])
    none = F.lit(None).cast(source.select(row.alias("r")).schema["r"].dataType)
    lasts = source.groupBy(*keys, span).agg(F.max_by(row, F.struct(F.col(date))).alias("_row"))
    asked = targets.groupBy(*keys, span).agg(F.lit(True).alias("_asked"))
    spans = lasts.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_row", none)).groupBy(*keys, "_span").agg(F.first("_row", ignorenulls=True).alias("_row"), F.max("_asked").alias("_asked"))
    earlier = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("_row", F.last("_row", ignorenulls=True).over(earlier)).where("_asked and _row is not null")
    kinds = dict(targets.dtypes)
    side = lambda df, n: df.select(
        *keys, (F.col(date) if n else F.lit(None).cast(kinds[date])).alias(date), F.col("_span") if n == 0 else span, F.lit(n).alias("_side"),
        *[(F.col(c) if n == 2 else F.lit(None).cast(kinds[c])).alias(c) for c in others], (F.col("_row") if n == 0 else row if n == 1 else none).alias("_row"),
    )
    w = W.partitionBy(*keys, "_span").orderBy(F.col("_side") > 0, date, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = side(carried, 0).unionByName(side(source, 1)).unionByName(side(targets, 2)).withColumn("_found", F.last("_row", ignorenulls=True).over(w))
    return both.where("_side = 2").select(*keys, date, *others, *[F.col(f"_found.{v}").alias(v) for v in values])


def multiply_by_day(cube: DataFrame, factors: DataFrame, values: Sequence[str], factor: str, keys: Sequence[str] = (), time: str = "time", date: str = "date") -> DataFrame:
    """Each value times the factor of its day (and keys); days without a factor give NULL. Of several factors of a day the least counts."""
    days = factors.groupBy(*keys, F.to_date(date).alias("_day")).agg(F.min(factor).alias("_factor"))
    joined = cube.withColumn("_day", F.to_date(time)).join(days, [*keys, "_day"], "left")
    kept: list[Column | str] = [F.col(c) * F.col("_factor") if c in values else F.col(c) for c in cube.columns]
    return joined.select(*[k.alias(c) for k, c in zip(kept, cube.columns, strict=True)])


def days_without_factor(cube: DataFrame, factors: DataFrame, time: str = "time", date: str = "date") -> DataFrame:
    """The days of a cube that the factors lack, for a strict check before multiplying."""
    return cube.select(F.to_date(time).alias(date)).distinct().join(factors.select(F.to_date(date).alias(date)), date, "left_anti")

