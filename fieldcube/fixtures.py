"""Domain tables as views over plain business tables, for queries and tests.

Each view is deterministic and exists in SQL too (``SQL``), so that a query can be
compared with another engine on the same rows.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcube import registry
from fieldcube.sources import tiff

#: A small crop calendar: sector, day, crop.
CROPS = [(0, "2019-01-10", "Crop"), (0, "2019-06-01", "Grass"), (1, "2019-03-01", "Crop"), (2, "2019-02-01", "Crop"), (3, "2019-08-01", "Crop")]
#: A polygon on the 8 x 8 grid of the fAPAR cube.
RING = [(0.5, 0.5), (6.5, 1.5), (5.5, 6.5), (1.5, 5.5), (0.5, 0.5)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exact_mean(x: Column) -> Column:
    """Mean of doubles, the same for any order of the rows, so that a mean halfway between two rounded values doesn't follow chance.

    Numbers up to 2^20 are added as whole multiples of 2^-10, 2^-35 and 2^-60, exactly and far from overflow; what is finer, and larger numbers, as doubles.
    """
    sums = []
    for bits in (10, 35, 60):
        whole = F.when(F.abs(x) <= 2.0**20, F.rint(x * 2.0**bits)).otherwise(F.when(x.isNotNull(), 0.0))
        sums.append(F.sum(whole.cast("long")) / 2.0**bits)
        x = x - whole / 2.0**bits
    return (sums[0] + (sums[1] + (sums[2] + F.sum(x)))) / F.nullif(F.count(x), F.lit(0))


def bands(spark: SparkSession, sf_dir: str, mean: Callable[[Column], Column] = F.avg) -> DataFrame:
    """A sparse cube of ten bands; some b06 are zero."""
    avg = lambda c: mean(F.col(c) if isinstance(c, str) else c)
    rows = read(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 5).alias("sector_id"), F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_suppkey") % 4).cast("double").alias("x")
    )
    return rows.agg(
        (avg("l_discount") * 0.5 + 0.0137).alias("b02"), (avg("l_tax") * 0.7 + 0.0211).alias("b03"), (avg(F.col("l_discount") + F.col("l_tax")) / 3.0).alias("b04"),
        (avg("l_tax") * 1.1 + 0.031).alias("b05"), (avg("l_tax") * 2.0).alias("b06"), (avg("l_quantity") / 117.0 + 0.05).alias("b07"), (avg("l_quantity") / 103.0).alias("b08"),
        (avg("l_quantity") / 101.0).alias("b8a"), (avg("l_extendedprice") / 210000.0).alias("b11"), (avg("l_extendedprice") / 430000.0).alias("b12"),
    )


def fapar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 8 x 8 cube, one time a day."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("sector_id"), F.date_add(F.lit("2019-01-01").cast("date"), F.col("vec_id").cast("int")).cast("timestamp").alias("time"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("sector_id", "time", F.floor(F.col("pos") / 8).cast("double").alias("y"), (F.col("pos") % 8).cast("double").alias("x"), F.least(F.abs(F.col("v").cast("double")) * 4.0, F.lit(1.0)).alias("fapar"))


def _weather(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("sector_id"), F.date_trunc(unit, t).alias("date"))
    return rows.agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "error", "purchase", "signup", "view")])


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir, "hour")


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir, "day")


def par(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value every 16 days for sectors 0 to 9."""
    day = F.date_add(F.lit("2019-01-01").cast("date"), 16 * F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    rows = read(spark, sf_dir, "events").groupBy(day.alias("date")).agg((F.avg("value") / 40.0).alias("par"))
    return rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("sector_id"), "date", "par")


def crop_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    plant = F.to_date("o_orderdate")
    return rows.select(F.col("o_custkey").alias("sector_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("crop_name"), plant.alias("plant_time"), F.date_add(plant, (F.col("o_orderkey") % 90).cast("int")).alias("harvest_time"))


def small_calendar(spark: SparkSession) -> DataFrame:
    rows = [(s, i, c, d, None) for i, (s, d, c) in enumerate(CROPS)]
    return spark.createDataFrame(rows, "sector_id long, seq int, crop_name string, plant_time string, harvest_time string")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values with gaps, for interpolation."""
    return _series(read(spark, sf_dir, "lineitem"))


def whole_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, under the name that later queries use."""
    return series(spark, sf_dir)


def _series(rows: DataFrame) -> DataFrame:
    return rows.groupBy((F.col("l_suppkey") % 20).alias("sector_id"), F.col("l_shipdate").cast("timestamp").alias("time")).agg(F.avg("l_quantity").alias("value"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("sector_id"), F.to_date("ts").alias("d")).distinct()


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parcel a user, three by two cells less one corner, in rows of three that lie a cell apart."""
    x = F.col("user_id") * 4 + F.floor(F.col("user_id") / 3) * 8
    corner = lambda a, b: F.struct((x + a).cast("double").alias("px"), F.lit(b).cast("double").alias("py"))
    ring = F.array(*[corner(*p) for p in ((-0.5, -0.5), (2.5, -0.5), (2.5, 1.5), (0.7, 1.5), (-0.5, 0.3), (-0.5, -0.5))])
    return read(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("sector_id"), x.alias("x0"), ring.alias("ring"))


def parcel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of parcels on the days with events: (sector_id, time, y, x, value)."""
    days = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sector_id"), F.to_date("ts").alias("d")).distinct()
    time = F.col("d").cast("timestamp") + F.expr("interval 12 hours")
    rows = days.join(parcels(spark, sf_dir), "sector_id").select("sector_id", time.alias("time"), "x0", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return rows.select("sector_id", "time", F.floor(F.col("i") / 3).cast("double").alias("y"), (F.col("x0") + F.col("i") % 3).cast("double").alias("x"), (F.col("i") / 10).alias("value"))


class Archive:
    """A transport with files for all days but each fifth, computed from the day and the place; each seventh day has two, of which the later lacks a quarter of its cells."""

    def __init__(self, options: dict):
        self.options = options

    def fetch(self, asked: dict) -> list[dict]:
        xs = [p[0] for ring in asked["rings"] for p in ring]
        ys = [p[1] for ring in asked["rings"] for p in ring]
        x, y = np.arange(math.ceil(min(xs)), math.floor(max(xs)) + 1), np.arange(math.floor(max(ys)), math.ceil(min(ys)) - 1, -1)
        band = np.arange(len(registry.PRODUCTS[asked["product"]].variables))[:, None, None]
        day, rows = dt.date.fromisoformat(asked["start"]), []
        while day <= dt.date.fromisoformat(asked["end"]):
            n = day.toordinal() - dt.date(1970, 1, 1).toordinal()
            values = (n * 31 + x[None, None, :] * 7 + y[None, :, None] * 3 + band * 11) % 100 / 100
            late = np.where((x[None, :] + y[:, None]) % 4 == 0, np.nan, values) if n % 7 == 0 else values
            for hour, bands in ((8, values + 1), (10, late)):
                if n % 5 and (hour == 10 or n % 7 == 0):
                    rows.append({"time": dt.datetime(day.year, day.month, day.day, hour, tzinfo=dt.UTC), "payload": tiff.encode(tiff.Raster(bands, float(x[0]), float(y[0]), 1.0, 1.0))})
            day += dt.timedelta(1)
        return rows


class Flaky(Archive):
    """An archive whose line breaks at the first attempt for every request."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.tried = set()

    def fetch(self, asked: dict) -> list[dict]:
        key = (asked["area_id"], asked["start"])
        if key not in self.tried:
            self.tried.add(key)
            raise OSError("the line broke")
        return super().fetch(asked)


SQL = {
    "parcels": """parcels AS (SELECT DISTINCT user_id, user_id * 4 + user_id // 3 * 8 AS x0 FROM events),
        gaps AS (
          SELECT user_id, x0, d::DATE AS d, d::DATE - DATE '1970-01-01' AS n FROM parcels, range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d)
          WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = parcels.user_id AND e.ts::DATE = d::DATE)),
        arrived AS (
          SELECT user_id, d, n, x0, (d + CASE WHEN n % 7 = 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 10 HOUR END)::TIMESTAMP AS time, (i // 3) AS y, x0 + i % 3 AS x, i = 3 AS outside,
            CASE WHEN n % 7 = 0 AND (x0 + i % 3 + i // 3) % 4 = 0 THEN 1e0 ELSE 0e0 END AS more
          FROM gaps, range(0, 6) c(i) WHERE n % 5 <> 0)""",
    "bands": """bands AS (
        SELECT l_suppkey % 5 AS sector_id, l_shipdate AS time, l_linenumber::DOUBLE AS y, (l_suppkey % 4)::DOUBLE AS x,
          avg(l_discount) * 0.5e0 + 0.0137e0 AS b02, avg(l_tax) * 0.7e0 + 0.0211e0 AS b03, avg(l_discount + l_tax) / 3e0 AS b04,
          avg(l_tax) * 1.1e0 + 0.031e0 AS b05, avg(l_tax) * 2e0 AS b06, avg(l_quantity) / 117e0 + 0.05e0 AS b07, avg(l_quantity) / 103e0 AS b08,
          avg(l_quantity) / 101e0 AS b8a, avg(l_extendedprice) / 210000e0 AS b11, avg(l_extendedprice) / 430000e0 AS b12
        FROM lineitem GROUP BY ALL)""",
    "fapar": """fapar AS (
        SELECT label::BIGINT AS sector_id, (DATE '2019-01-01' + vec_id::INT)::TIMESTAMP AS time, (pos // 8)::DOUBLE AS y, (pos % 8)::DOUBLE AS x,
          least(abs(v::DOUBLE) * 4e0, 1e0) AS fapar
        FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))""",
    "weather_hourly": """weather_hourly AS (
        SELECT user_id % 10 AS sector_id, date_trunc('hour', ts)::TIMESTAMP AS date, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error,
          avg(value) FILTER (event_type = 'purchase') AS purchase, avg(value) FILTER (event_type = 'signup') AS signup, avg(value) FILTER (event_type = 'view') AS "view"
        FROM events GROUP BY 1, 2)""",
    "weather_daily": """weather_daily AS (
        SELECT user_id % 10 AS sector_id, date_trunc('day', ts)::TIMESTAMP AS date, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error,
          avg(value) FILTER (event_type = 'purchase') AS purchase, avg(value) FILTER (event_type = 'signup') AS signup, avg(value) FILTER (event_type = 'view') AS "view"
        FROM events GROUP BY 1, 2)""",
    "par": """par AS (
        SELECT s.sector_id::BIGINT AS sector_id, date, par FROM
          (SELECT DATE '2019-01-01' + (16 * (ts::DATE - DATE '2024-01-01'))::INT AS date, avg(value) / 40e0 AS par FROM events GROUP BY 1), range(0, 10) s(sector_id))""",
    "crop_calendar": """crop_calendar AS (
        SELECT o_custkey AS sector_id, o_orderkey AS seq, o_orderpriority AS crop_name, o_orderdate::DATE AS plant_time, o_orderdate::DATE + (o_orderkey % 90)::INT AS harvest_time FROM orders)""",
    "small_calendar": "small_calendar(sector_id, date, crop_name) AS (VALUES " + ", ".join(f"({s}::BIGINT, DATE '{d}', '{c}')" for s, d, c in CROPS) + ")",
    "series": """series AS (
        SELECT l_suppkey % 20 AS sector_id, l_shipdate AS time, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)""",
    "whole_series": """series AS (
        SELECT l_suppkey % 20 AS sector_id, l_shipdate AS time, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)""",
    "user_days": "user_days AS (SELECT DISTINCT user_id AS sector_id, ts::DATE AS d FROM events)",
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views before it; "NAME AS (...)" texts stand for themselves. A body may go on with more views after a comma."""
    body = body.strip()
    return "WITH " + ",\n".join(SQL.get(v, v) for v in views) + "\n" + body if views else body
