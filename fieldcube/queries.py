"""One query per operator, and its SQL for another engine. Numbers are rounded beyond the data's own precision."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcube import fixtures as fx
from fieldcube import registry
from fieldcube.fixtures import read, sql
from fieldcube.functions import geometry as g
from fieldcube.functions import indices, projections, scalars
from fieldcube.operators import crops, cube, dates, frames, growth, spatial, sync, temporal, weather
from fieldcube.plans import background, derived, gpp, requests, satellite
from fieldcube.sources import images, partitioned, staging, tables, tiff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def near(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: near(c, digits) for c in columns})


# Indices

_INDEX_SQL = {
    "savi": "(b08 - b04) / nullif(b08 + b04 + 0.5e0, 0)",
    "ndvi": "(b08 - b04) / nullif(b08 + b04, 0)",
    "evi": "2.5e0 * (b08 - b04) / nullif(b08 + 6e0 * b04 - 7.5e0 * b02 + 1e0, 0)",
    "evi2": "2.4e0 * (b08 - b04) / nullif(b08 + b04 + 1e0, 0)",
    "gndvi": "(b08 - b03) / nullif(b08 + b03, 0)",
    "msi": "(b08 - b04) / nullif(b08 + b04, 0)",
    "ndmi": "(b08 - b11) / nullif(b08 + b11, 0)",
    "nbr": "(b08 - b12) / nullif(b08 + b12, 0)",
    "psri": "(b04 - b02) / nullif(b06, 0)",
    "ari": "1e0 / nullif(b03, 0) - 1e0 / nullif(b05, 0)",
    "arvi": "(b8a - b04 - 0.106e0 * (b04 - b02)) / nullif(b8a + b04 - 0.106e0 * (b04 - b02), 0)",
    "sipi": "(b08 - b02) / nullif(b08 - b04, 0)",
    "ndyi": "(b03 - b02) / nullif(b03 + b02, 0)",
}
_R = "round({0}, 6) + 0e0 AS {1}"


def _index(name: str) -> Query:
    return lambda spark, sf: rounded(indices.composites(fx.bands(spark, sf), [name]), [name])


for _name, _rule in _INDEX_SQL.items():
    query(_name, sql(f"SELECT sector_id, time, y, x, {_R.format(_rule, _name)} FROM bands", "bands"))(_index(_name))


@query("composites_all", sql("SELECT sector_id, time, y, x, " + ", ".join(_R.format(v, k) for k, v in _INDEX_SQL.items()) + " FROM bands", "bands"))
def composites_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indices.composites(fx.bands(spark, sf)), list(indices.RULES))


# Cubes

_NDVI = "ndvi AS (SELECT sector_id, time, y, x, (b08 - b04) / nullif(b08 + b04, 0) AS ndvi FROM bands)"


def ndvi(spark: SparkSession, sf: str) -> DataFrame:
    return indices.composites(fx.bands(spark, sf), ["ndvi"])


@query("cube_full", sql("SELECT sector_id, time, y, x, round(fapar, 6) + 0e0 AS fapar FROM fapar", "fapar"))
def cube_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cube.summaries(fx.fapar(spark, sf), ["full", "unknown"])["full"], ["fapar"])


@query("spatial_mean", sql("SELECT sector_id, time, round(avg(ndvi), 6) + 0e0 AS ndvi FROM ndvi GROUP BY 1, 2", "bands", _NDVI))
def spatial_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cube.spatial_mean(ndvi(spark, sf)), ["ndvi"])


@query("temporal_mean", sql("SELECT sector_id, y, x, round(avg(ndvi), 6) + 0e0 AS ndvi FROM ndvi GROUP BY 1, 2, 3", "bands", _NDVI))
def temporal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cube.temporal_mean(ndvi(spark, sf)), ["ndvi"])


@query("grid_mean_append", sql("SELECT sector_id, time, y, x, round(fapar, 6) + 0e0 AS fapar, round(avg(fapar) OVER (PARTITION BY sector_id, time), 6) + 0e0 AS fapar_mean FROM fapar", "fapar"))
def grid_mean_append(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cube.append_means(fx.fapar(spark, sf), ["fapar"]), ["fapar", "fapar_mean"])


@query("time_slice", sql("SELECT sector_id, time, y, x, round(b08, 6) + 0e0 AS b08 FROM bands WHERE time::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-05-31'", "bands"))
def time_slice(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cube.time_slice(fx.bands(spark, sf).select(*cube.KEYS, "b08"), "1995-03-01", "1995-05-31"), ["b08"])


@query("point_sample", sql("""
    , g AS (SELECT sector_id, coalesce(max(x) FILTER (x <= 2.5), min(x)) AS gx, coalesce(min(y) FILTER (y >= 3.5), max(y)) AS gy FROM bands GROUP BY 1),
    m AS (SELECT sector_id, time, avg(b08) AS b08_mean FROM bands GROUP BY 1, 2)
    SELECT b.sector_id, b.time, round(b.b08, 6) + 0e0 AS b08, round(m.b08_mean, 6) + 0e0 AS b08_mean
    FROM bands b JOIN g ON b.sector_id = g.sector_id AND b.x = g.gx AND b.y = g.gy JOIN m ON m.sector_id = b.sector_id AND m.time = b.time""".strip(), "bands"))  # fmt: skip
def point_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.point_sample(fx.bands(spark, sf).select(*cube.KEYS, "b08"), 2.5, 3.5, ["b08"]), ["b08", "b08_mean"])


@query("first_by_key", sql("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"))
def first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return cube.first_by_key(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# Growth, interpolation, alignment

_MONTH = 2592000000000
_OVER = {"prev": f"{_MONTH} PRECEDING AND 1 PRECEDING", "curr": f"CURRENT ROW AND {_MONTH - 1} FOLLOWING", "next": f"{_MONTH} FOLLOWING AND {2 * _MONTH - 1} FOLLOWING"}


@query("ags_growth", sql(f"""
    , times AS (SELECT DISTINCT sector_id, time FROM bands),
    counts AS (SELECT sector_id, time, {", ".join(f"count(*) OVER (PARTITION BY sector_id ORDER BY epoch_us(time) RANGE BETWEEN {w} ) AS {n}_n" for n, w in _OVER.items())} FROM times),
    pixels AS (SELECT DISTINCT sector_id, y, x FROM bands),
    grid AS (SELECT t.sector_id, t.time, p.y, p.x, n.ndvi FROM times t JOIN pixels p USING (sector_id) LEFT JOIN ndvi n ON n.sector_id = t.sector_id AND n.time = t.time AND n.y = p.y AND n.x = p.x),
    means AS (SELECT *, {", ".join(f"avg(ndvi) OVER (PARTITION BY sector_id, y, x ORDER BY epoch_us(time) RANGE BETWEEN {_OVER[n]}) AS {n}_m" for n in ("prev", "next"))} FROM grid)
    SELECT sector_id, time, y, x, CASE WHEN least(prev_n, curr_n, next_n) >= 8 THEN round(next_m - prev_m, 6) + 0e0 END AS ags FROM means JOIN counts USING (sector_id, time)""".strip(), "bands", _NDVI))  # fmt: skip
def ags_growth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(growth.rolling_growth(ndvi(spark, sf)), ["ags"])


_SEGMENTS = """segments AS (SELECT sector_id, time AS t0, value AS v0, lead(time) OVER w AS t1, lead(value) OVER w AS v1 FROM series WINDOW w AS (PARTITION BY sector_id ORDER BY time)),
    days AS (SELECT sector_id, t0, v0, t1, v1, unnest(generate_series(t0, coalesce(t1 - INTERVAL 1 DAY, t0), INTERVAL 1 DAY)) AS time FROM segments),
    parts AS (SELECT *, (epoch_us(time) - epoch_us(t0)) / nullif(epoch_us(t1) - epoch_us(t0), 0)::DOUBLE AS part FROM days)"""


@query("interp_linear_daily", sql("SELECT sector_id, time, round(CASE WHEN time = t0 THEN v0 ELSE v0 + (v1 - v0) * part END, 6) + 0e0 AS value FROM parts", "series", _SEGMENTS))
def interp_linear_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(temporal.interpolate_daily(fx.series(spark, sf), ["sector_id"], "value"), ["value"])


@query("interp_nearest_daily", sql("SELECT sector_id, time, round(CASE WHEN time = t0 OR part <= 0.5 THEN v0 ELSE v1 END, 6) + 0e0 AS value FROM parts", "series", _SEGMENTS))
def interp_nearest_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(temporal.interpolate_daily(fx.series(spark, sf), ["sector_id"], "value", "nearest"), ["value"])


@query("interp_linear_daily_all", sql("SELECT sector_id, time, round(CASE WHEN time = t0 THEN v0 ELSE v0 + (v1 - v0) * part END, 6) + 0e0 AS value FROM parts", "whole_series", _SEGMENTS))
def interp_linear_daily_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(temporal.interpolate_daily(fx.whole_series(spark, sf), ["sector_id"], "value"), ["value"])


@query("interp_nearest_daily_all", sql("SELECT sector_id, time, round(CASE WHEN time = t0 OR part <= 0.5 THEN v0 ELSE v1 END, 6) + 0e0 AS value FROM parts", "whole_series", _SEGMENTS))
def interp_nearest_daily_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(temporal.interpolate_daily(fx.whole_series(spark, sf), ["sector_id"], "value", "nearest"), ["value"])


_CUBIC = sql("""
    , places AS (
        SELECT sector_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY sector_id) AS n, epoch_us(time) / 864e8 AS x, value AS y, lead(epoch_us(time) / 864e8) OVER w - epoch_us(time) / 864e8 AS h, lead(value) OVER w - value AS dy
        FROM series WINDOW w AS (PARTITION BY sector_id ORDER BY time)),
    equations AS (  -- one for each inner value, the ends' put into their neighbours'
        SELECT sector_id, i, n, CASE WHEN i = n - 2 THEN g - h * h / g ELSE g END AS low, CASE WHEN i = 1 THEN h - g * g / h ELSE h END AS high,
          2e0 * (g + h) + CASE WHEN i = 1 THEN g * (g + h) / h ELSE 0e0 END + CASE WHEN i = n - 2 THEN h * (g + h) / g ELSE 0e0 END AS mid, 6e0 * (dy / h - before) AS b
        FROM (SELECT *, lag(h) OVER w AS g, lag(dy / h) OVER w AS before FROM places WINDOW w AS (PARTITION BY sector_id ORDER BY i)) WHERE i BETWEEN 1 AND n - 2),
    down AS (
        SELECT sector_id, i, high / mid AS c, b / mid AS r FROM equations WHERE i = 1
        UNION ALL SELECT e.sector_id, e.i, e.high / (e.mid - e.low * d.c), (e.b - e.low * d.r) / (e.mid - e.low * d.c) FROM down d JOIN equations e ON e.sector_id = d.sector_id AND e.i = d.i + 1),
    up AS (
        SELECT d.sector_id, d.i, d.r AS m FROM down d JOIN equations e ON e.sector_id = d.sector_id AND e.i = d.i WHERE d.i = e.n - 2
        UNION ALL SELECT d.sector_id, d.i, d.r - d.c * u.m FROM up u JOIN down d ON d.sector_id = u.sector_id AND d.i = u.i - 1),
    bent AS (
        SELECT p.*, CASE WHEN p.i = 0 THEN ((p.h + lead(p.h) OVER w) * lead(u.m) OVER w - p.h * lead(u.m, 2) OVER w) / lead(p.h) OVER w
            WHEN p.i = p.n - 1 THEN ((lag(p.h) OVER w + lag(p.h, 2) OVER w) * lag(u.m) OVER w - lag(p.h) OVER w * lag(u.m, 2) OVER w) / lag(p.h, 2) OVER w ELSE u.m END AS m
        FROM places p LEFT JOIN up u ON u.sector_id = p.sector_id AND u.i = p.i WINDOW w AS (PARTITION BY p.sector_id ORDER BY p.i)),
    pieces AS (SELECT *, lead(m) OVER (PARTITION BY sector_id ORDER BY i) AS m1 FROM bent),
    days AS (SELECT sector_id, unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS time FROM series GROUP BY 1)
    SELECT d.sector_id, d.time, round(CASE WHEN epoch_us(d.time) / 864e8 = p.x THEN p.y
        ELSE p.y + (epoch_us(d.time) / 864e8 - p.x) * (p.dy / p.h - p.h * (2 * p.m + p.m1) / 6 + (epoch_us(d.time) / 864e8 - p.x) * (p.m / 2 + (epoch_us(d.time) / 864e8 - p.x) * (p.m1 - p.m) / (6 * p.h))) END, 6) + 0e0 AS value
    FROM days d ASOF JOIN pieces p ON d.sector_id = p.sector_id AND epoch_us(d.time) / 864e8 >= p.x""".strip(), "series").replace("WITH ", "WITH RECURSIVE ", 1)  # fmt: skip


@query("interp_cubic_daily", _CUBIC)
def interp_cubic_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(temporal.interpolate_daily(fx.whole_series(spark, sf), ["sector_id"], "value", "cubic"), ["value"])


@query("asof_backward", sql("""
    , targets AS (SELECT DISTINCT o_custkey AS sector_id, l_shipdate::DATE AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    source AS (SELECT o_custkey AS sector_id, o_orderdate::DATE AS date, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
    SELECT t.sector_id, t.date, s.price FROM targets t ASOF LEFT JOIN source s ON t.sector_id = s.sector_id AND t.date >= s.date""".strip(), "one AS (SELECT 1)"))  # fmt: skip
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    targets = read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("sector_id"), F.to_date("l_shipdate").alias("date")).distinct()
    source = orders.groupBy(F.col("o_custkey").alias("sector_id"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("price"))
    return temporal.as_of(targets, source, ["sector_id"], ["price"])


@query("multiply_daily", sql("SELECT f.sector_id, f.time, f.y, f.x, round(f.fapar * p.par, 6) + 0e0 AS fapar FROM fapar f LEFT JOIN par p ON p.sector_id = f.sector_id AND p.date = f.time::DATE", "fapar", "par"))
def multiply_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(temporal.multiply_by_day(fx.fapar(spark, sf), fx.par(spark, sf), ["fapar"], "par", ["sector_id"]), ["fapar"])


# Calendars

_MISSING = """missing AS (SELECT k.sector_id, c.d::DATE AS d FROM (SELECT DISTINCT sector_id FROM user_days) k,
      (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d) c WHERE NOT EXISTS (SELECT 1 FROM user_days u WHERE u.sector_id = k.sector_id AND u.d = c.d::DATE))"""


def _missing(spark: SparkSession, sf: str) -> DataFrame:
    have = fx.user_days(spark, sf)
    return dates.missing_days(have, have.select("sector_id").distinct(), "2024-01-01", "2024-01-30")


@query("missing_dates", sql("SELECT sector_id, d FROM missing", "user_days", _MISSING))
def missing_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _missing(spark, sf)


@query("date_islands", sql("SELECT sector_id, min(d) AS start, max(d) AS \"end\" FROM (SELECT *, d - row_number() OVER (PARTITION BY sector_id ORDER BY d)::INT AS run FROM missing) GROUP BY sector_id, run", "user_days", _MISSING))
def date_islands(spark: SparkSession, sf: str) -> DataFrame:
    return dates.islands(_missing(spark, sf), ["sector_id"])


@query("split_date_range", """
    SELECT start, "end", CASE WHEN start <= DATE '2024-01-14' THEN start END AS archive_start, CASE WHEN start <= DATE '2024-01-14' THEN least("end", DATE '2024-01-14') END AS archive_end,
      CASE WHEN "end" >= DATE '2024-01-15' THEN greatest(start, DATE '2024-01-15') END AS forecast_start, CASE WHEN "end" >= DATE '2024-01-15' THEN "end" END AS forecast_end
    FROM (SELECT min(ts)::DATE AS start, max(ts)::DATE AS "end" FROM events GROUP BY user_id % 50)""")  # fmt: skip
def split_date_range(spark: SparkSession, sf: str) -> DataFrame:
    ranges = read(spark, sf, "events").groupBy(F.col("user_id") % 50).agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end")).select("start", "end")
    return dates.split_ranges(ranges, "2024-01-20")


@query("same_day_midpoint", "SELECT user_id AS sector_id, ts::DATE AS d, make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS time FROM events GROUP BY 1, 2")
def same_day_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    return dates.same_day_midpoint(read(spark, sf, "events").select(F.col("user_id").alias("sector_id"), F.col("ts").alias("time")), ["sector_id"])


@query("distinct_dates", sql("SELECT DISTINCT sector_id, time::DATE AS d FROM bands UNION SELECT sector_id, max(time)::DATE + 1 FROM bands GROUP BY 1", "bands"))
def distinct_dates(spark: SparkSession, sf: str) -> DataFrame:
    b = fx.bands(spark, sf)
    return dates.distinct_days(b, b.groupBy("sector_id").agg(F.date_add(F.to_date(F.max("time")), 1).alias("d")))


@query("reconcile_dates", """
    WITH a AS (SELECT DISTINCT user_id AS sector_id, ts::DATE AS d, ts FROM events WHERE event_type <> 'view'), k AS (SELECT DISTINCT user_id AS sector_id, ts::DATE AS d, true AS known FROM events WHERE event_type IN ('view', 'click'))
    SELECT sector_id, d, coalesce(ts, d::TIMESTAMP) AS time, k.known IS NULL AS quarantined FROM a FULL JOIN k USING (sector_id, d)""")
def reconcile_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Instants of all events but views, against the days with views or clicks."""
    events = read(spark, sf, "events").select(F.col("user_id").alias("sector_id"), F.col("ts").alias("time"), F.to_date("ts").alias("d"), "event_type")
    known = events.where("event_type in ('view', 'click')").select("sector_id", "d").distinct()
    return dates.reconcile(events.where("event_type <> 'view'").select("sector_id", "time").distinct(), known, ["sector_id"])


# Crops and production

@query("crop_change_points", sql("""
    , events AS (SELECT sector_id, seq, plant_time AS date, crop_name, 1 AS planted FROM crop_calendar UNION ALL SELECT sector_id, seq, harvest_time, 'Grass', 0 FROM crop_calendar WHERE harvest_time - plant_time >= 30),
    daily AS (SELECT sector_id, date, crop_name FROM events QUALIFY row_number() OVER (PARTITION BY sector_id, date ORDER BY planted DESC, seq DESC) = 1)
    SELECT sector_id, date, crop_name FROM (SELECT *, lag(crop_name) OVER (PARTITION BY sector_id ORDER BY date) AS before FROM daily) WHERE before IS NULL OR before <> crop_name""".strip(), "crop_calendar"))  # fmt: skip
def crop_change_points(spark: SparkSession, sf: str) -> DataFrame:
    return crops.change_points(fx.crop_calendar(spark, sf), "Grass", 30)


_BPLUT = "bplut(biome, " + ", ".join(registry.BPLUT_COLUMNS) + ") AS (VALUES " + ", ".join(f"('{k}', " + ", ".join(f"{v!r}::DOUBLE" for v in vs) + ")" for k, vs in registry.BPLUT.items()) + ")"
_BIOME = "crop_biome(crop_name, biome) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in registry.CROP_BIOME.items()) + ")"


@query("bplut_lookup", sql("SELECT biome, crop_name, sector_id, date, " + ", ".join(registry.BPLUT_COLUMNS) + " FROM small_calendar JOIN crop_biome USING (crop_name) JOIN bplut USING (biome)", "small_calendar", _BIOME, _BPLUT))
def bplut_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.small_calendar(spark).select("sector_id", F.to_date("plant_time").alias("date"), "crop_name")
    return crops.with_biome(c, registry.crop_biome(spark), registry.bplut(spark), registry.BPLUT_COLUMNS)


_GPP = """gpp AS (SELECT f.sector_id, f.time, f.y, f.x, f.fapar * (b.lue_max * p.par) AS gpp FROM fapar f
      ASOF LEFT JOIN small_calendar c ON f.sector_id = c.sector_id AND f.time::DATE >= c.date
      ASOF LEFT JOIN par p ON f.sector_id = p.sector_id AND f.time::DATE >= p.date
      LEFT JOIN crop_biome cb ON cb.crop_name = c.crop_name LEFT JOIN bplut b ON b.biome = cb.biome)"""
_GPP_VIEWS = ("fapar", "par", "small_calendar", _BIOME, _BPLUT, _GPP)


def production(spark: SparkSession, sf: str) -> DataFrame:
    return gpp.gpp(fx.fapar(spark, sf), fx.par(spark, sf), fx.small_calendar(spark), registry.crop_biome(spark), registry.bplut(spark))


@query("gpp_full", sql("SELECT sector_id, time, y, x, round(gpp, 9) + 0e0 AS gpp FROM gpp", *_GPP_VIEWS))
def gpp_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(production(spark, sf), ["gpp"], 9)


@query("gpp_spatial_mean", sql("SELECT sector_id, time, round(avg(gpp), 9) + 0e0 AS gpp FROM gpp GROUP BY 1, 2", *_GPP_VIEWS))
def gpp_spatial_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gpp.summaries(production(spark, sf), ["spatial_mean"])["spatial_mean"], ["gpp"], 9)


@query("gpp_temporal_mean", sql("SELECT sector_id, y, x, round(avg(gpp), 9) + 0e0 AS gpp FROM gpp GROUP BY 1, 2, 3", *_GPP_VIEWS))
def gpp_temporal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gpp.summaries(production(spark, sf), ["temporal_mean"])["temporal_mean"], ["gpp"], 9)


# Weather

_W = ["click", "error", "purchase", "signup", "view"]
_W_SQL = ", ".join(f'round("{v}", 9) + 0e0 AS "{v}"' for v in _W)


@query("weather_hourly", sql(f"SELECT sector_id, date, {_W_SQL} FROM weather_hourly", "weather_hourly"))
def weather_hourly(spark: SparkSession, sf: str) -> DataFrame:
    long = read(spark, sf, "events").select((F.col("user_id") % 10).alias("sector_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date"), F.col("event_type").alias("variable"), "value")
    return rounded(weather.widen(long, _W), _W, 9)


@query("weather_daily", sql(f"SELECT sector_id, date, {_W_SQL} FROM weather_daily", "weather_daily"))
def weather_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(frames.sorted_columns(fx.weather_daily(spark, sf), ["sector_id", "date"]), _W, 9)


@query("weather_long", sql("SELECT sector_id, date, variable, round(value, 9) + 0e0 AS value FROM (UNPIVOT weather_daily ON click, error, purchase, signup, \"view\" INTO NAME variable VALUE value) WHERE value IS NOT NULL", "weather_daily"))
def weather_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weather.lengthen(fx.weather_daily(spark, sf)), ["value"], 9)


_NEEDED = {"hourly": ["click", "view"], "daily": ["error", "purchase"]}
_COMMON = """common AS (SELECT DISTINCT sector_id, date::DATE AS d FROM weather_hourly WHERE click IS NOT NULL AND "view" IS NOT NULL
      INTERSECT SELECT DISTINCT sector_id, date::DATE FROM weather_daily WHERE error IS NOT NULL AND purchase IS NOT NULL)"""


def _frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"hourly": fx.weather_hourly(spark, sf), "daily": fx.weather_daily(spark, sf)}


@query("weather_common_dates", sql("SELECT sector_id, d FROM common", "weather_hourly", "weather_daily", _COMMON))
def weather_common_dates(spark: SparkSession, sf: str) -> DataFrame:
    return weather.common_complete_days(_frames(spark, sf), _NEEDED)


@query("weather_missing_ranges", sql("""
    , missing AS (SELECT s.sector_id, c.d::DATE AS d FROM (SELECT DISTINCT sector_id FROM weather_daily) s, (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS d) c
      WHERE NOT EXISTS (SELECT 1 FROM common u WHERE u.sector_id = s.sector_id AND u.d = c.d::DATE))
    SELECT sector_id, min(d) AS start, max(d) AS "end" FROM (SELECT *, d - row_number() OVER (PARTITION BY sector_id ORDER BY d)::INT AS run FROM missing) GROUP BY sector_id, run""".strip(), "weather_hourly", "weather_daily", _COMMON))  # fmt: skip
def weather_missing_ranges(spark: SparkSession, sf: str) -> DataFrame:
    f = _frames(spark, sf)
    return weather.gaps(f, _NEEDED, f["daily"], "2023-12-25", "2024-02-05")


@query("weather_sync", sql("""
    , cache AS (SELECT sector_id, date, variable, value FROM (UNPIVOT weather_daily ON click, "view" INTO NAME variable VALUE value) WHERE value IS NOT NULL AND day(date) <= 20),
    fetched AS (SELECT sector_id, date, variable, value + 1 AS value FROM (UNPIVOT weather_daily ON click, "view" INTO NAME variable VALUE value) WHERE value IS NOT NULL AND day(date) >= 10)
    SELECT sector_id, date, variable, round(coalesce(c.value, f.value), 9) + 0e0 AS value FROM cache c FULL JOIN fetched f USING (sector_id, date, variable) WHERE date::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""".strip(), "weather_daily"))  # fmt: skip
def weather_sync(spark: SparkSession, sf: str) -> DataFrame:
    long = weather.lengthen(fx.weather_daily(spark, sf).select("sector_id", "date", "click", "view"))
    gaps = long.where("day(date) >= 10").select("sector_id", F.to_date("date").alias("start"), F.to_date("date").alias("end")).distinct()

    def fetch(asked: DataFrame) -> DataFrame:
        days = asked.select("sector_id", F.col("start").alias("_day"))
        return long.withColumn("_day", F.to_date("date")).join(days, ["sector_id", "_day"]).select("sector_id", "date", "variable", (F.col("value") + 1).alias("value"))

    return rounded(weather.sync(long.where("day(date) <= 20"), fetch, gaps, "2024-01-05", "2024-01-25"), ["value"], 9)


# Upserts

_SIDES = """new_ AS (SELECT sector_id, time, y, x, b08 AS v FROM bands WHERE time >= TIMESTAMP '1998-01-01'), old_ AS (SELECT sector_id, time, y, x, b04 AS v FROM bands WHERE time < TIMESTAMP '1999-01-01')"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = fx.bands(spark, sf, fx.exact_mean)
    return b.where("time < timestamp'1999-01-01'").select(*cube.KEYS, F.col("b04").alias("v")), b.where("time >= timestamp'1998-01-01'").select(*cube.KEYS, F.col("b08").alias("v"))


def _upsert_sql(first: str, second: str) -> str:
    return sql(
        f"SELECT sector_id, time, y, x, round(v, 6) + 0e0 AS v FROM (SELECT * FROM {first} UNION ALL SELECT * FROM {second} s WHERE NOT EXISTS (SELECT 1 FROM {first} f WHERE f.sector_id = s.sector_id AND f.time = s.time))",
        "bands", _SIDES,
    )


@query("upsert_new_wins", _upsert_sql("new_", "old_"))
def upsert_new_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sync.upsert(*_sides(spark, sf), "new"), ["v"])


@query("upsert_old_wins", _upsert_sql("old_", "new_"))
def upsert_old_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sync.upsert(*_sides(spark, sf), "old"), ["v"])


@query("spatial_merge", sql("SELECT sector_id, time, y, x, round(coalesce(a.v, b.v), 6) + 0e0 AS v FROM (SELECT * FROM new_ WHERE x <= 2) a FULL JOIN (SELECT * FROM old_ WHERE x >= 1) b USING (sector_id, time, y, x)", "bands", _SIDES))
def spatial_merge(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    return rounded(sync.spatial_merge(new.where("x <= 2"), old.where("x >= 1"), ["v"]), ["v"])


@query("subset_check", sql("SELECT n.sector_id, n.time, n.y, n.x, round(n.v, 6) + 0e0 AS v FROM new_ n LEFT JOIN old_ o ON n.sector_id = o.sector_id AND n.time = o.time AND n.x = o.x AND n.y = o.y WHERE o.v IS NULL OR abs(o.v - n.v) > 1e-10", "bands", _SIDES))
def subset_check(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    return rounded(sync.not_contained(new, old, "v"), ["v"])


@query("regrid_nearest", sql("SELECT sector_id, time, y, x + 0.3e0 AS x, round(b08, 6) + 0e0 AS b08 FROM bands", "bands"))
def regrid_nearest(spark: SparkSession, sf: str) -> DataFrame:
    b = fx.bands(spark, sf).select(*cube.KEYS, "b08")
    return rounded(sync.regrid_nearest(b, b.select("sector_id", "y", (F.col("x") + 0.3).alias("x")).distinct()), ["b08"])


@query("no_data_union", "SELECT sector_id, 'bands' AS product, d FROM (SELECT DISTINCT user_id AS sector_id, ts::DATE AS d FROM events WHERE event_type = 'view' UNION SELECT DISTINCT user_id, ts::DATE FROM events WHERE event_type = 'error')")
def no_data_union(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda k: read(spark, sf, "events").where(F.col("event_type") == k).select(F.col("user_id").alias("sector_id"), F.lit("bands").alias("product"), F.to_date("ts").alias("d"))
    return sync.record_no_data(of("view"), of("error"))


@query("sync_union", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS acctbal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def sync_union(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return sync.sync_union(a, read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))


@query("product_sync", sql("SELECT sector_id, time, y, x, round(v, 6) + 0e0 AS v FROM (SELECT * FROM old_ WHERE time::DATE BETWEEN DATE '1998-11-01' AND DATE '1999-02-28' UNION ALL SELECT * FROM new_ n WHERE time::DATE BETWEEN DATE '1998-11-01' AND DATE '1999-02-28' AND NOT EXISTS (SELECT 1 FROM old_ o WHERE o.sector_id = n.sector_id AND o.time::DATE = n.time::DATE))", "bands", _SIDES))
def product_sync(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    nothing = spark.createDataFrame([], "sector_id long, product string, d date")

    def fetch(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        day = F.to_date("time")
        return new.join(wanted, "sector_id").where((day >= F.col("start")) & (day <= F.col("end"))).select(*new.columns), nothing

    rows, _ = sync.sync_product(old, nothing, old.select("sector_id").distinct(), "1998-11-01", "1999-02-28", fetch, "bands")
    return rounded(rows, ["v"])


# Space

def _ring_sql(x: str, y: str, ring: Sequence[tuple[float, float]] = fx.RING) -> str:
    hits = [f"(({y1}e0 > {y}) <> ({y2}e0 > {y}) AND {x} < ({x2}e0 - {x1}e0) * ({y} - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0)::INT" for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False) if y1 != y2]
    return f"(({' + '.join(hits)}) % 2 = 1)"


_BOX = "x BETWEEN 0.5 AND 6.5 AND y BETWEEN 0.5 AND 6.5"


@query("polygon_bbox", sql(f"SELECT sector_id, time, y, x, round(fapar, 6) + 0e0 AS fapar FROM fapar WHERE {_BOX}", "fapar"))
def polygon_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.within_box(fx.fapar(spark, sf), fx.RING), ["fapar"])


@query("polygon_mask", sql(f"SELECT sector_id, time, y, x, CASE WHEN {_ring_sql('x', 'y')} THEN round(fapar, 6) + 0e0 END AS fapar FROM fapar WHERE {_BOX}", "fapar"))
def polygon_mask(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.mask(fx.fapar(spark, sf), fx.RING, ["fapar"]), ["fapar"])


@query("polygon_crop", sql(f"SELECT sector_id, time, y, x, CASE WHEN {_ring_sql('(x + 0.5e0)', '(y - 0.5e0)')} THEN round(fapar, 6) + 0e0 END AS fapar FROM fapar", "fapar"))
def polygon_crop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.mask(fx.fapar(spark, sf), fx.RING, ["fapar"], box=False, dx=0.5, dy=-0.5), ["fapar"])


def _lonlat(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(k, (9.0 + (k % 5) * 0.1).alias("lon"), (45.0 + (k % 7) * 0.3).alias("lat"))


_LONLAT = "p AS (SELECT s_suppkey, 9e0 + (s_suppkey % 5) * 0.1e0 AS lon, 45e0 + (s_suppkey % 7) * 0.3e0 AS lat FROM supplier)"


def _utm_sql() -> str:
    n = g.FLATTENING / (2 - g.FLATTENING)
    a = g.EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    east = " + ".join(["eta"] + [f"{c!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(alpha, 1)])
    north = " + ".join(["xi"] + [f"{c!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(alpha, 1)])
    return sql(f"""
    , t AS (SELECT s_suppkey, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 9) AS lam FROM p),
    u AS (SELECT s_suppkey, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT s_suppkey, round(500000e0 + {0.9996 * a!r}::DOUBLE * ({east}), 4) + 0e0 AS easting, round({0.9996 * a!r}::DOUBLE * ({north}), 4) + 0e0 AS northing FROM u""".strip(), _LONLAT)  # fmt: skip


@query("reproject_utm", _utm_sql())
def reproject_utm(spark: SparkSession, sf: str) -> DataFrame:
    east, north = g.utm(F.col("lon"), F.col("lat"), 32)
    return _lonlat(spark, sf).select("s_suppkey", near(east, 4).alias("easting"), near(north, 4).alias("northing"))


@query("metric_to_degrees", sql("SELECT s_suppkey, round(10e0 / 6378137e0 * (180 / pi()), 12) AS dlat, round(10e0 / 6378137e0 * (180 / pi()) / cos(radians(lat)), 12) AS dlon FROM p", _LONLAT))
def metric_to_degrees(spark: SparkSession, sf: str) -> DataFrame:
    dlat, dlon = g.metres_to_degrees(F.lit(10.0), F.col("lat"))
    return _lonlat(spark, sf).select("s_suppkey", F.round(dlat, 12).alias("dlat"), F.round(dlon, 12).alias("dlon"))


@query("guess_crs", sql("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 4326 ELSE 25832 END AS crs FROM p", _LONLAT))
def guess_crs(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("s_suppkey") % 2 == 0
    x, y = F.when(even, F.col("lon")).otherwise(660000.0), F.when(even, F.col("lat")).otherwise(5740000.0)
    return _lonlat(spark, sf).select("s_suppkey", g.guess_crs(x, y).alias("crs"))


def _squares(spark: SparkSession, sf: str, table: str, key: str, name: str) -> DataFrame:
    """Unit squares at places that follow from the key."""
    k = F.col(key)
    x, y = ((k * 7) % 50).cast("double"), ((k * 13) % 50).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("px"), (y + b).alias("py"))
    return read(spark, sf, table).select(k.alias(name), F.array(corner(0.1, 0.1), corner(1.6, 0.1), corner(1.6, 1.6), corner(0.1, 1.6), corner(0.1, 0.1)).alias("ring"))


@query("polygon_intersects", """
    WITH a AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 50 AS x, (s_suppkey * 13) % 50 AS y FROM supplier), b AS (SELECT c_custkey AS area_id, (c_custkey * 7) % 50 AS x, (c_custkey * 13) % 50 AS y FROM customer)
    SELECT id, area_id FROM a, b WHERE abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5""")  # fmt: skip
def polygon_intersects(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.intersecting(_squares(spark, sf, "supplier", "s_suppkey", "id"), _squares(spark, sf, "customer", "c_custkey", "area_id"), 2.0)


@query("polygon_intersects_all", """
    WITH a AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 50 AS x, (s_suppkey * 13) % 50 AS y FROM supplier), b AS (SELECT c_custkey AS area_id, (c_custkey * 7) % 50 AS x, (c_custkey * 13) % 50 AS y FROM customer)
    SELECT id, area_id FROM a, b WHERE abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5""")  # fmt: skip
def polygon_intersects_all(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.intersecting(_squares(spark, sf, "supplier", "s_suppkey", "id"), _squares(spark, sf, "customer", "c_custkey", "area_id"), 2.0)


@query("ring_measures", """
    SELECT s_suppkey AS id, round((s_suppkey * 7) % 50 + 0.85e0, 6) + 0e0 AS cx, round((s_suppkey * 13) % 50 + 0.85e0, 6) + 0e0 AS cy, round((s_suppkey * 7) % 50 + 0.1e0, 6) AS min_x, round((s_suppkey * 13) % 50 + 1.6e0, 6) AS max_y,
      round((s_suppkey * 7) % 50 + 0.1e0 - 0.25e0, 6) AS buffered_min_x, round((s_suppkey * 13) % 50 + 1.6e0 + 0.25e0, 6) AS buffered_max_y FROM supplier""")  # fmt: skip
def ring_measures(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(_squares(spark, sf, "supplier", "s_suppkey", "id"))


@query("ring_measures_all", """
    SELECT s_suppkey AS id, round((s_suppkey * 7) % 50 + 0.85e0, 6) + 0e0 AS cx, round((s_suppkey * 13) % 50 + 0.85e0, 6) + 0e0 AS cy, round((s_suppkey * 7) % 50 + 0.1e0, 6) AS min_x, round((s_suppkey * 13) % 50 + 1.6e0, 6) AS max_y,
      round((s_suppkey * 7) % 50 + 0.1e0 - 0.25e0, 6) AS buffered_min_x, round((s_suppkey * 13) % 50 + 1.6e0 + 0.25e0, 6) AS buffered_max_y FROM supplier""")  # fmt: skip
def ring_measures_all(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(_squares(spark, sf, "supplier", "s_suppkey", "id"))


def _measures(rows: DataFrame) -> DataFrame:
    wide = rows.withColumn("wide", g.buffered(F.col("ring"), F.lit(0.25))).withColumn("c", g.centroid(F.col("ring")))
    x0, _, _, y1 = g.bounds(F.col("ring"))
    bx, _, _, by = g.bounds(F.col("wide"))
    return wide.select("id", near("c.x").alias("cx"), near("c.y").alias("cy"), F.round(x0, 6).alias("min_x"), F.round(y1, 6).alias("max_y"), F.round(bx, 6).alias("buffered_min_x"), F.round(by, 6).alias("buffered_max_y"))


_IMAGE_RING = [(float((x - 0.5) * 8 // 6), float((6.5 - y) * 8 // 6)) for x, y in fx.RING]


@query("image_alpha", f"SELECT vec_id, (pos // 8)::INT AS \"row\", (pos % 8)::INT AS col, CASE WHEN {_ring_sql('(pos % 8)::DOUBLE', '(pos // 8)::DOUBLE', _IMAGE_RING)} THEN 255 ELSE 0 END AS a FROM (SELECT vec_id, unnest(range(0, 64)) AS pos FROM embeddings)")
def image_alpha(spark: SparkSession, sf: str) -> DataFrame:
    pixels = read(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")).select("vec_id", F.expr("cast(pos div 8 as int)").alias("row"), (F.col("pos") % 8).cast("int").alias("col"))
    return spatial.image_alpha(pixels, fx.RING, 8, 8)


@query("image_size", "SELECT s_suppkey, CASE WHEN a >= b THEN 500 ELSE floor(a * 500 / b)::BIGINT END AS width, CASE WHEN a >= b THEN floor(b * 500 / a)::BIGINT ELSE 500 END AS height FROM (SELECT s_suppkey, 1e0 + s_suppkey % 7 AS a, 1e0 + s_suppkey % 5 AS b FROM supplier)")
def image_size(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    width, height = scalars.image_size(1.0 + k % 7, 1.0 + k % 5, 500)
    return read(spark, sf, "supplier").select(k, width.cast("long").alias("width"), height.cast("long").alias("height"))


# Plain tables

@query("soil_left_joins", "SELECT s_suppkey, s_name, s_acctbal, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def soil_left_joins(spark: SparkSession, sf: str) -> DataFrame:
    geo = read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "BF_ID")
    info = read(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "BF_ID", "n_regionkey": "TKLE_NR"})
    legend = read(spark, sf, "region").withColumnRenamed("r_regionkey", "TKLE_NR")
    return frames.soil_chain(geo, info, legend).select("s_suppkey", "s_name", "s_acctbal", "n_name", "r_name")


@query("natural_merge", "SELECT s_nationkey AS k, s_name, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def natural_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    return frames.merge(frames.merge(None, a), read(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_name"))


@query("background_mean", "SELECT l_suppkey AS sector_id, 'discount' AS layer, round(avg(CASE WHEN l_discount <= 0 THEN 0 ELSE l_discount END), 6) + 0e0 AS value FROM lineitem GROUP BY 1")
def background_mean(spark: SparkSession, sf: str) -> DataFrame:
    cells = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sector_id"), F.lit("discount").alias("layer"), F.when(F.col("l_discount") <= 0, -9999.0).otherwise(F.col("l_discount")).alias("value"))
    return rounded(background.layer_means(cells), ["value"])


@query("cube_join", sql("SELECT f.sector_id, f.time, f.y, f.x, round(f.fapar, 6) + 0e0 AS fapar, round(g.half, 6) + 0e0 AS half FROM fapar f JOIN (SELECT sector_id, time, y, x, fapar / 2 AS half FROM fapar WHERE x < 5) g USING (sector_id, time, y, x)", "fapar"))
def cube_join(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.fapar(spark, sf)
    return rounded(frames.join_cubes([f, f.where("x < 5").select(*cube.KEYS, (F.col("fapar") / 2).alias("half"))]), ["fapar", "half"])


@query("band_merge", sql("SELECT sector_id, time, y, x, round(b04, 6) + 0e0 AS b04, CASE WHEN x > 0 THEN round(b08, 6) + 0e0 END AS b08 FROM bands", "bands"))
def band_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = fx.bands(spark, sf)
    layers = {"b04": b.select(*cube.KEYS, F.col("b04").alias("value")), "b08": b.where("x > 0").select(*cube.KEYS, F.col("b08").alias("value"))}
    return rounded(frames.merge_bands(layers), ["b04", "b08"])


@query("sector_slice", "SELECT s_nationkey::VARCHAR AS farm_id, s_suppkey AS sector_id FROM supplier ORDER BY s_nationkey::VARCHAR, s_suppkey LIMIT 20 OFFSET 10")
def sector_slice(spark: SparkSession, sf: str) -> DataFrame:
    return cube.sector_slice(read(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("farm_id"), F.col("s_suppkey").alias("sector_id")), 10, 30)


_SEGMENTS_OF_CUSTOMERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in _SEGMENTS_OF_CUSTOMERS) + ", c_custkey FROM customer")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return frames.one_hot(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("flat_frames", sql("SELECT sector_id, date, round(click, 9) + 0e0 AS click FROM weather_daily", "weather_daily"))
def flat_frames(spark: SparkSession, sf: str) -> DataFrame:
    _, daily, _ = frames.flat_frames([fx.fapar(spark, sf)], fx.weather_daily(spark, sf).select("sector_id", "date", "click"), None)
    return rounded(daily, ["click"], 9)


@query("roof", "SELECT l_orderkey, l_linenumber, CASE WHEN v = trunc(v) THEN trunc(v)::BIGINT ELSE trunc(v)::BIGINT + 1 END AS roof FROM (SELECT l_orderkey, l_linenumber, l_quantity / 4 - 3 AS v FROM lineitem)")
def roof(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.roof(F.col("l_quantity") / 4 - 3).alias("roof"))


@query("path_rewrite", "SELECT url, replace('/data/' || url, '/data', 'files') AS local FROM pages")
def path_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("url", scalars.local_path(F.concat(F.lit("/data/"), "url")).alias("local"))


# JSON and files

@query("par_json_parse", "SELECT user_id AS sector_id, ts::DATE AS date, round(max(value), 6) + 0e0 AS par FROM events GROUP BY 1, 2")
def par_json_parse(spark: SparkSession, sf: str) -> DataFrame:
    days = read(spark, sf, "events").groupBy(F.col("user_id").alias("sector_id"), F.date_format("ts", "yyyyMMdd").alias("k")).agg(F.max("value").alias("v"))
    maps = days.groupBy("sector_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    body = F.to_json(F.struct(F.struct(F.struct(F.col("m").alias("ALLSKY_SFC_PAR_TOT")).alias("parameter")).alias("properties")))
    return rounded(weather.par_series(maps.select("sector_id", body.alias("payload"))), ["par"])


@query("weather_time_grid", "SELECT user_id AS sector_id, make_timestamp((epoch_us(date_trunc('day', min(ts))) + i * 3600000000)::BIGINT) AS date, 'k' AS variable, (i * 1.5e0) AS value FROM events, range(0, 24) r(i) GROUP BY user_id, i")
def weather_time_grid(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_timestamp(F.date_trunc("day", F.min(F.col("ts").cast("timestamp"))))
    answers = read(spark, sf, "events").groupBy(F.col("user_id").alias("sector_id")).agg(start.alias("start"))
    values = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: i * 1.5)
    return weather.time_grid(answers.select("sector_id", "start", (F.col("start") + 86400).alias("end"), F.lit(3600).cast("long").alias("interval"), F.create_map(F.lit("k"), values).alias("variables")))


@query("request_parse", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN 'farm' || c_custkey % 7 END, 'generic_farm') AS farm_id, 's' || c_custkey AS sector_id, DATE '2019-07-01' AS start, DATE '2019-07-15' AS \"end\", 5 AS points FROM customer")
def request_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    farm = F.when(k % 3 > 0, F.concat(F.lit('"farm'), k % 7, F.lit('"'))).otherwise("null")
    body = F.concat(
        F.lit('{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}, "input_data": {"id": {"farm_id": '), farm,
        F.lit(', "sector_id": "s'), k, F.lit('"}}, "requests": {"date_range": ["2019-07-01", "2019-07-15"], "copernicus_data": {"fapar": ["full"]}}}'),
    )
    parsed = requests.parse_many(read(spark, sf, "customer").select("c_custkey", body.alias("body")))
    return parsed.select("c_custkey", "farm_id", "sector_id", "start", "end", F.size("ring").alias("points"))


@query("json_records", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS record FROM nation")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    return tables.as_json(read(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(float("nan")).alias("none")))


@query("event_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_props(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("tiff_roundtrip", sql("SELECT sector_id::VARCHAR AS sector_id, time, y, x, round(fapar, 6) + 0e0 AS fapar FROM fapar", "fapar"))
def tiff_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Cubes as raster files in memory and back, one file a sector and time."""
    files = tiff.in_memory(fx.fapar(spark, sf), "fapar", 4326)
    return rounded(tiff.explode_tiffs(files, ["sector_id", "time"]).select("sector_id", "time", "y", "x", F.col("value").alias("fapar")), ["fapar"])


@query("request_answer", sql("""
    , masked AS (SELECT sector_id, time, y, x, CASE WHEN """ + _ring_sql("x", "y") + """ THEN fapar END AS fapar FROM fapar WHERE sector_id = 3 AND time::DATE BETWEEN DATE '2019-02-01' AND DATE '2019-06-30' AND """ + _BOX + """)
    SELECT sector_id, time, round(avg(fapar), 6) + 0e0 AS fapar FROM masked GROUP BY 1, 2""", "fapar"))  # fmt: skip
def request_answer(spark: SparkSession, sf: str) -> DataFrame:
    body = {
        "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in fx.RING]]},
        "input_data": {"id": {"farm_id": "f", "sector_id": "3"}},
        "requests": {"date_range": ["2019-02-01", "2019-06-30"], "copernicus_data": {"fapar": ["spatial_mean"]}},
    }
    return rounded(requests.run_request(spark, body, {"fapar": fx.fapar(spark, sf)})["fapar.spatial_mean"], ["fapar"])


# Answers and caches, end to end

_RING_BODY = {"geometry": {"type": "Polygon", "coordinates": [[list(p) for p in fx.RING]]}, "input_data": {"id": {"farm_id": "f", "sector_id": "3"}}}
_MASKED = f"CASE WHEN {_ring_sql('x', 'y')} THEN (b08 - b04) / nullif(b08 + b04, 0) END"


@query("request_ags", sql(f"""
    , cells AS (SELECT sector_id, time, y, x, {_MASKED} AS ndvi FROM bands WHERE sector_id = 3 AND {_BOX}),
    times AS (SELECT DISTINCT time FROM cells),
    counts AS (SELECT time, {", ".join(f"count(*) OVER (ORDER BY epoch_us(time) RANGE BETWEEN {w}) AS {n}_n" for n, w in _OVER.items())} FROM times),
    pixels AS (SELECT DISTINCT y, x FROM cells),
    grid AS (SELECT t.time, p.y, p.x, n.ndvi FROM times t CROSS JOIN pixels p LEFT JOIN cells n ON n.time = t.time AND n.y = p.y AND n.x = p.x),
    means AS (SELECT *, {", ".join(f"avg(ndvi) OVER (PARTITION BY y, x ORDER BY epoch_us(time) RANGE BETWEEN {_OVER[n]}) AS {n}_m" for n in ("prev", "next"))} FROM grid),
    grown AS (SELECT time, y, x, CASE WHEN least(prev_n, curr_n, next_n) >= 8 THEN next_m - prev_m END AS ags FROM means JOIN counts USING (time))
    SELECT 3::BIGINT AS sector_id, time, round(avg(ags), 6) + 0e0 AS ags FROM grown WHERE time::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-15' GROUP BY time""", "bands"))  # fmt: skip
def request_ags(spark: SparkSession, sf: str) -> DataFrame:
    """Growth for two weeks, from the whole cache's windows."""
    body = _RING_BODY | {"requests": {"date_range": ["1995-03-01", "1995-03-15"], "copernicus_data": {"composites": {"ags": ["spatial_mean"]}}}}
    return rounded(requests.run_request(spark, body, {"bands": fx.bands(spark, sf)})["ags.spatial_mean"], ["ags"])


#: A ring that has no cell of the grid on an edge, where projections decide.
_NO_EDGES = [(0.6, 0.55), (6.4, 1.45), (5.45, 6.4), (1.55, 5.4), (0.6, 0.55)]


@query("request_utm", sql("""
    , masked AS (SELECT sector_id, time, CASE WHEN """ + _ring_sql("x", "y", _NO_EDGES) + """ THEN fapar END AS fapar FROM fapar WHERE sector_id = 3 AND time::DATE BETWEEN DATE '2019-02-01' AND DATE '2019-06-30')
    SELECT sector_id, time, round(avg(fapar), 6) + 0e0 AS fapar FROM masked GROUP BY 1, 2""", "fapar"))  # fmt: skip
def request_utm(spark: SparkSession, sf: str) -> DataFrame:
    """A ring in degrees on a cube in metres: the grid's steps are a thousandth of a degree."""
    place = lambda c: F.col(c) / 1000
    east, north = g.utm(9 + place("x"), 48 + place("y"))
    moved = fx.fapar(spark, sf).withColumns({"_e": east, "_n": north}).select("sector_id", "time", F.col("_n").alias("y"), F.col("_e").alias("x"), "fapar")
    moved = staging.Staged(spark, "utm").table(moved)  # as a cache would be: coordinates are columns
    meta = spark.createDataFrame([("3", "fapar", 32632)], "sector_id string, product string, crs int")
    ring = [[9 + x / 1000, 48 + y / 1000] for x, y in _NO_EDGES]
    body = _RING_BODY | {"geometry": {"type": "Polygon", "coordinates": [ring]}, "requests": {"date_range": ["2019-02-01", "2019-06-30"], "copernicus_data": {"fapar": ["spatial_mean"]}}}
    return rounded(requests.run_request(spark, body, {"fapar": moved, "cube_meta": meta})["fapar.spatial_mean"], ["fapar"])


@query("sync_cube", _upsert_sql("new_", "old_"))
def sync_cube(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sync.sync_cube(*_sides(spark, sf), "v"), ["v"])


@query("ingest_old_wins", sql(
    "SELECT sector_id, time, y, x, round(v, 6) + 0e0 AS v FROM (SELECT * FROM old_ UNION ALL SELECT * FROM new_ s WHERE x < 2 AND NOT EXISTS (SELECT 1 FROM old_ f WHERE f.sector_id = s.sector_id AND f.time = s.time))", "bands", _SIDES))
def ingest_old_wins(spark: SparkSession, sf: str) -> DataFrame:
    """A batch in which a half of the cells is broken."""
    old, new = _sides(spark, sf)
    return rounded(sync.ingest(old, new.withColumn("_error", F.when(F.col("x") >= 2, "broken")))[0], ["v"])


@query("ingest_quarantine", sql("SELECT sector_id, time, y, x, 'broken' AS _error FROM new_ WHERE x >= 2", "bands", _SIDES))
def ingest_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    return sync.ingest(old, new.withColumn("_error", F.when(F.col("x") >= 2, "broken")))[1].select("sector_id", "time", "y", "x", "_error")


@query("cube_concat", sql("SELECT sector_id, time, y, x, round(v, 6) + 0e0 AS v, NULL::DOUBLE AS w FROM old_ UNION ALL SELECT sector_id, time, y, x, NULL, round(v, 6) + 0e0 FROM new_", "bands", _SIDES))
def cube_concat(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _sides(spark, sf)
    return rounded(frames.merge(old, new.withColumnRenamed("v", "w"), "concat"), ["v", "w"])


@query("sorted_days", "SELECT o_custkey, d, row_number() OVER (PARTITION BY o_custkey ORDER BY d) - 1 AS place FROM (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders)")
def sorted_days(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's order days as text in any order, sorted as dates."""
    days = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.to_date("o_orderdate").cast("string")).alias("days"))
    return days.select("o_custkey", F.posexplode(dates.sorted_days(F.col("days"))).alias("place", "d")).withColumn("place", F.col("place").cast("long"))


@query("flat_pixels", sql("SELECT sector_id, time AS date, y, x, round(ndvi, 6) + 0e0 AS ndvi, round(b08, 6) + 0e0 AS b08 FROM ndvi JOIN bands USING (sector_id, time, y, x)", "bands", _NDVI))
def flat_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Two products' cells side by side over all sectors."""
    pixels, _, _ = frames.flat_frames([ndvi(spark, sf), fx.bands(spark, sf).select(*cube.KEYS, "b08")], None, None)
    return rounded(pixels, ["ndvi", "b08"])


# Acquisition

def _acquired(spark: SparkSession, sf: str, product: str, band: str, transport: str = "Archive") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parcels, and the caches after the days without events were downloaded; those with events are in the cache before, at noon."""
    store = satellite.Store.at(spark, f"{staging.shared_dir(spark)}/satellite-{uuid.uuid4().hex}", product)
    parcels = fx.parcels(spark, sf)
    cells = fx.parcel_cells(spark, sf).withColumnRenamed("value", band)
    store.cube.merge(cells.select("*", *[F.lit(None).cast("double").alias(v) for v in registry.PRODUCTS[product].variables if v != band]))
    return parcels, satellite.update(store, parcels, product, "2024-01-01", "2024-01-30", f"fieldcube.fixtures:{transport}", today="2024-03-01", buffer=0.6, tile=1000.0, wait=0.0)


@query("satellite_sync", sql("""
    SELECT user_id::VARCHAR AS sector_id, time, y::DOUBLE AS y, x::DOUBLE AS x, CASE WHEN NOT outside THEN round((n * 31 + x * 7 + y * 3) % 100 / 100e0 + more, 6) + 0e0 END AS leaf_area FROM arrived
    UNION ALL SELECT user_id::VARCHAR, (d + INTERVAL 12 HOUR)::TIMESTAMP, (i // 3)::DOUBLE, (x0 + i % 3)::DOUBLE, round(i / 10e0, 6) + 0e0 FROM (SELECT DISTINCT user_id, ts::DATE AS d FROM events) JOIN parcels USING (user_id), range(0, 6) c(i)""", "parcels"))  # fmt: skip
def satellite_sync(spark: SparkSession, sf: str) -> DataFrame:
    """A parcel a request: buffered, downloaded once a gap, cropped back, one time a day."""
    return rounded(_acquired(spark, sf, "leaf_area", "leaf_area")[1]["cube"], ["leaf_area"])


@query("satellite_no_data", sql("SELECT user_id::VARCHAR AS sector_id, 'leaf_area' AS product, d FROM gaps WHERE n % 5 = 0", "parcels"))
def satellite_no_data(spark: SparkSession, sf: str) -> DataFrame:
    """Days found to be empty by the same sync."""
    return _acquired(spark, sf, "leaf_area", "leaf_area")[1]["no_data"]


@query("satellite_groups", sql("""
    , groups AS (
        SELECT user_id, user_id // 3 AS three, user_id - row_number() OVER (PARTITION BY floor((x0 - 0.5) / 1000), user_id // 3 ORDER BY user_id) AS run FROM parcels),
    members AS (SELECT user_id, min(user_id::VARCHAR) OVER (PARTITION BY three, run, floor((x0 - 0.5) / 1000)) AS area FROM groups JOIN parcels USING (user_id)),
    asked AS (SELECT DISTINCT area, n FROM members JOIN gaps USING (user_id)),
    runs AS (SELECT area, count(DISTINCT run) AS requests FROM (SELECT area, n - row_number() OVER (PARTITION BY area ORDER BY n) AS run FROM asked) GROUP BY 1),
    sums AS (
        SELECT user_id, d, count(DISTINCT (x, y)) AS cells, round(sum((n * 31 + x * 7 + y * 3 + b * 11) % 100 / 100e0 + more) FILTER (NOT outside), 4) + 0e0 AS total
        FROM arrived, range(0, 13) t(b) GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS sector_id, d, cells, total, area AS area_id, requests FROM sums JOIN members USING (user_id) JOIN runs USING (area)""", "parcels"))  # fmt: skip
def satellite_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels whose buffered boxes touch are asked for together; each one's cells by day, and its area's requests."""
    parcels, got = _acquired(spark, sf, "bands", "b02")
    bands = registry.PRODUCTS["bands"].variables
    total = near(F.sum(sum((F.coalesce(F.col(b), F.lit(0.0)) for b in bands), F.lit(0.0))), 4)
    sums = got["cube"].where("hour(time) <> 12").groupBy("sector_id", F.to_date("time").alias("d")).agg(F.count(F.lit(1)).alias("cells"), total.alias("total"))
    requests_ = got["ledger"].groupBy("area_id").agg(F.count(F.lit(1)).alias("requests"))
    return sums.join(satellite.areas(parcels, "bands", 0.6, 1000.0).select("sector_id", "area_id"), "sector_id").join(requests_, "area_id").select("sector_id", "d", "cells", "total", "area_id", "requests")


# Derived caches

def _derived(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Caches made from four of five days, then brought up to all days."""
    store = derived.Derived.at(spark, f"{staging.shared_dir(spark)}/derived-{uuid.uuid4().hex}", ["ndmi", "savi"])
    bands = fx.bands(spark, sf)
    derived.refresh(store, bands.where("datediff(time, DATE '1970-01-01') % 5 <> 3"))
    return derived.refresh(store, bands)


@query("growth_refresh", ORACLE_SQL["ags_growth"].replace("SELECT sector_id, time, y, x, CASE", "SELECT sector_id::VARCHAR AS sector_id, time, y, x, CASE"))
def growth_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Growth after days that came later, against the growth of all days."""
    return rounded(_derived(spark, sf)["growth"], ["ags"])


@query("composites_refresh", sql("SELECT sector_id::VARCHAR AS sector_id, time, y, x, " + ", ".join(_R.format(_INDEX_SQL[n], n) for n in ("ndmi", "ndvi", "savi")) + " FROM bands", "bands"))
def composites_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Composites written back to their cache, in two steps."""
    return rounded(_derived(spark, sf)["composites"], ["ndmi", "ndvi", "savi"])


# Windows of raster files

@query("tiff_window", """
    SELECT l_linenumber AS file, (l_suppkey % 80)::DOUBLE AS y, (l_partkey % 96)::DOUBLE AS x, round(avg(l_quantity), 6) + 0e0 AS value
    FROM lineitem WHERE l_suppkey % 80 BETWEEN 5 AND 30 AND l_partkey % 96 BETWEEN 20 AND 40 GROUP BY ALL""")  # fmt: skip
def tiff_window(spark: SparkSession, sf: str) -> DataFrame:
    """Cubes written as tiled, compressed files, of which only the tiles of a box are read."""
    folder = f"{staging.shared_dir(spark)}/tiff-{uuid.uuid4().hex}"
    cells = read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("sector_id"), (F.col("l_suppkey") % 80).cast("double").alias("y"), (F.col("l_partkey") % 96).cast("double").alias("x"))
    cells = cells.agg(F.avg("l_quantity").alias("value")).withColumn("time", F.lit("2020-01-01").cast("timestamp"))
    tiff.write_tiffs(cells, "value", folder, tile=16, deflate=True, grid=(0.0, 79.0, 1.0, 96, 80)).count()
    rows = tiff.scan_tiffs(spark, folder).where("x >= 20 and x <= 40 and y >= 5 and y <= 30 and value is not null")
    return rows.select(F.regexp_extract("path", r"/(\d+)/value_", 1).cast("int").alias("file"), "y", "x", near("value").alias("value"))


# Coordinate systems

def _lambert_sql() -> str:
    """Web Mercator, Lambert's azimuthal (3035) and conic (3034) coordinates, by their textbook formulas."""
    e2, a = projections.E2, projections.A
    e = math.sqrt(e2)
    q = lambda s: f"((1 - {e2!r}) * ({s} / (1 - {e2!r} * {s} * {s}) - 1e0 / (2 * {e!r}) * ln((1 - {e!r} * {s}) / (1 + {e!r} * {s}))))"
    t = lambda p: f"(tan(pi() / 4 - {p} / 2) / pow((1 - {e!r} * sin({p})) / (1 + {e!r} * sin({p})), {e!r} / 2))"
    m = lambda p: f"(cos({p}) / sqrt(1 - {e2!r} * pow(sin({p}), 2)))"
    return f"""
    WITH p AS (SELECT s_suppkey, 6e0 + (s_suppkey * 37 % 600) / 100e0 AS lon, 46e0 + (s_suppkey * 53 % 900) / 100e0 AS lat FROM supplier),
    k AS (
        SELECT {q("1e0")} AS qp, {q("sin(radians(52e0))")} AS q0, (ln({m("radians(35e0)")}) - ln({m("radians(65e0)")})) / (ln({t("radians(35e0)")}) - ln({t("radians(65e0)")})) AS n),
    c AS (
        SELECT *, {a!r} * sqrt(qp / 2) AS rq, asin(q0 / qp) AS b0, {m("radians(35e0)")} / (n * pow({t("radians(35e0)")}, n)) AS f FROM k),
    d AS (SELECT *, {a!r} * {m("radians(52e0)")} / (rq * cos(b0)) AS d, {a!r} * f * pow({t("radians(52e0)")}, n) AS r0 FROM c),
    r AS (SELECT *, radians(lon - 10e0) AS dl, asin({q("sin(radians(lat))")} / qp) AS beta, {a!r} * f * pow({t("radians(lat)")}, n) AS r FROM p, d),
    b AS (SELECT *, rq * sqrt(2e0 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) AS b FROM r)
    SELECT s_suppkey, round({a!r} * radians(lon), 4) + 0e0 AS merc_x, round({a!r} * ln(tan(pi() / 4 + radians(lat) / 2)), 4) + 0e0 AS merc_y,
      round(4321000e0 + b * d * cos(beta) * sin(dl), 4) AS laea_x, round(3210000e0 + b / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)), 4) AS laea_y,
      round(4000000e0 + r * sin(n * dl), 4) AS lcc_x, round(2800000e0 + r0 - r * cos(n * dl), 4) AS lcc_y, true AS back FROM b"""


@query("reproject_europe", _lambert_sql())
def reproject_europe(spark: SparkSession, sf: str) -> DataFrame:
    """Places in three systems, and whether all of them, and a zone through its neighbour, come back to a millimetre."""
    k = F.col("s_suppkey")
    places = read(spark, sf, "supplier").select("s_suppkey", (6.0 + (k * 37 % 600) / 100.0).alias("lon"), (46.0 + (k * 53 % 900) / 100.0).alias("lat"))
    for name, crs in (("merc", 3857), ("laea", 3035), ("lcc", 3034)):
        x, y = projections.transformed(F.col("lon"), F.col("lat"), 4326, crs)
        places = places.withColumns({f"{name}_x": x, f"{name}_y": y})
    east, north = projections.transformed(F.col("lon"), F.col("lat"), 4326, 32632)
    places = places.withColumns({"e32": east, "n32": north})
    back = F.lit(True)
    for x, y, crs in (("merc_x", "merc_y", 3857), ("laea_x", "laea_y", 3035), ("lcc_x", "lcc_y", 3034)):
        lon, lat = projections.transformed(F.col(x), F.col(y), crs, 4326)
        back = back & (F.abs(lon - F.col("lon")) < 1e-8) & (F.abs(lat - F.col("lat")) < 1e-8)
    e33, n33 = projections.transformed(F.col("e32"), F.col("n32"), 32632, 32633)
    own_e, own_n = projections.transformed(F.col("lon"), F.col("lat"), 4326, 32633)
    back = back & (F.hypot(e33 - own_e, n33 - own_n) < 2e-3)
    return places.select("s_suppkey", *[near(c, 4).alias(c) for c in ("merc_x", "merc_y", "laea_x", "laea_y", "lcc_x", "lcc_y")], back.alias("back"))


# Requests for composites, production and background

def _body(**asked) -> dict:
    return _RING_BODY | {"requests": {"date_range": ["2019-02-01", "2019-06-30"]} | asked, "input_data": {"id": {"farm_id": "f", "sector_id": "3"}, "crop_data": [{"crop_name": "weizen", "plant_time": "2019-01-02"}]}}


_IN_RING = f"CASE WHEN {_ring_sql('x', 'y')} THEN {{0}} END"


@query("request_composites", sql(f"""
    SELECT sector_id, time, round(avg({_IN_RING.format(_INDEX_SQL["savi"])}), 6) + 0e0 AS savi, round(avg({_IN_RING.format(_INDEX_SQL["ndmi"])}), 6) + 0e0 AS ndmi
    FROM bands WHERE sector_id = 3 AND {_BOX} GROUP BY 1, 2""".strip(), "bands"))  # fmt: skip
def request_composites(spark: SparkSession, sf: str) -> DataFrame:
    """Two composites of one request: one from its cache, one from the bands."""
    bands = fx.bands(spark, sf)
    tables_ = {"bands": bands, "composites": indices.composites(bands, ["ndmi"])}
    body = _body(date_range=["1990-01-01", "2010-12-31"], copernicus_data={"composites": {"savi": ["spatial_mean"], "ndmi": ["spatial_mean"]}})
    got = requests.run_request(spark, body, tables_)
    return rounded(got["savi.spatial_mean"].join(got["ndmi.spatial_mean"], ["sector_id", "time"]), ["savi", "ndmi"])


@query("request_gpp", sql(f"""
    , cells AS (SELECT sector_id, time, y, x, fapar FROM fapar WHERE sector_id = 3 AND time::DATE BETWEEN DATE '2019-02-01' AND DATE '2019-06-30' AND {_BOX} AND {_ring_sql("x", "y")}),
    pieces AS (SELECT *, lead(time) OVER w AS t1, lead(fapar) OVER w AS v1 FROM cells WINDOW w AS (PARTITION BY y, x ORDER BY time)),
    days AS (SELECT sector_id, y, x, time AS t0, fapar AS v0, t1, v1, unnest(generate_series(time, coalesce(t1 - INTERVAL 1 DAY, time), INTERVAL 1 DAY)) AS time FROM pieces),
    daily AS (SELECT sector_id, time, avg(CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(time) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END) AS fapar FROM days GROUP BY 1, 2)
    SELECT d.sector_id, d.time, round(d.fapar * {registry.BPLUT["Crop"][0]!r} * p.par, 9) + 0e0 AS gpp FROM daily d ASOF LEFT JOIN par p ON p.sector_id = d.sector_id AND d.time::DATE >= p.date""".strip(), "fapar", "par"))  # fmt: skip
def request_gpp(spark: SparkSession, sf: str) -> DataFrame:
    """Production with linear interpolation to days, from a request."""
    body = _body(photosynthesis={"mean": ["spatial_mean"], "interpolation": "linear"})
    return rounded(requests.run_request(spark, body, {"fapar": fx.fapar(spark, sf), "par": fx.par(spark, sf)})["gpp.spatial_mean"], ["gpp"], 9)


@query("request_background", f"""
    WITH places AS (SELECT c_custkey AS area_id, c_nationkey, (c_custkey * 7) % 50 AS px, (c_custkey * 3) % 40 AS py FROM customer),
    corners AS (SELECT area_id, c_nationkey, bool_or({_ring_sql("x", "y")}) AS met FROM (SELECT *, px + a AS x, py + b AS y FROM places, (VALUES (0.13e0), (0.41e0)) s(a), (VALUES (0.13e0), (0.41e0)) t(b)) GROUP BY 1, 2),
    cells AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'clay' ELSE 'sand' END AS layer, (p_partkey % 8)::DOUBLE AS x, (p_partkey // 8 % 8)::DOUBLE AS y, p_retailprice AS v FROM part),
    means AS (SELECT avg(v) FILTER (layer = 'clay') AS clay, avg(v) FILTER (layer = 'sand') AS sand FROM cells WHERE {_BOX} AND {_ring_sql("x", "y")})
    SELECT '3' AS sector_id, area_id, n_name, r_name, round(clay, 6) + 0e0 AS clay, round(sand, 6) + 0e0 AS sand
    FROM corners JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, means WHERE met""")  # fmt: skip
def request_background(spark: SparkSession, sf: str) -> DataFrame:
    """Soil attributes and raster means of a request's ring; soil polygons are small boxes, which meet the ring if a corner does."""
    k = F.col("c_custkey")
    corner = lambda a, b: F.struct(((k * 7) % 50 + a).alias("px"), ((k * 3) % 40 + b).alias("py"))
    ring = F.array(corner(0.13, 0.13), corner(0.41, 0.13), corner(0.41, 0.41), corner(0.13, 0.41), corner(0.13, 0.13))
    geo = read(spark, sf, "customer").select(k.alias("area_id"), ring.alias("ring"), F.col("c_nationkey").alias("BF_ID"))
    info = read(spark, sf, "nation").select(F.col("n_nationkey").alias("BF_ID"), "n_name", F.col("n_regionkey").alias("TKLE_NR"))
    legend = read(spark, sf, "region").select(F.col("r_regionkey").alias("TKLE_NR"), "r_name")
    p = F.col("p_partkey")
    cells = read(spark, sf, "part").select(F.lit("3").alias("sector_id"), F.when(F.col("p_size") % 2 == 0, "clay").otherwise("sand").alias("layer"), (F.floor(p / 8) % 8).cast("double").alias("y"), (p % 8).cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("value"))
    got = requests.run_request(spark, _body(), {"soil_geo": geo, "soil_info": info, "soil_legend": legend, "bg_raster": cells})["background"]
    return rounded(got.select("sector_id", "area_id", "n_name", "r_name", "clay", "sand"), ["clay", "sand"])


@query("biome_parameters", sql("""
    , crops AS (SELECT o_custkey AS sector_id, o_orderdate::DATE AS date, list_extract(['Crop', 'Grass', 'weizen', 'kartoffeln', 'grassland'], (o_orderkey % 5 + 1)::INT) AS crop_name FROM orders)
    SELECT sector_id, date, crop_name, biome, lue_max, sla, q10 FROM crops JOIN crop_biome USING (crop_name) JOIN bplut USING (biome)""".strip(), _BIOME, _BPLUT))  # fmt: skip
def biome_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of each order's crop."""
    names = F.array(*[F.lit(n) for n in ("Crop", "Grass", "weizen", "kartoffeln", "grassland")])
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("sector_id"), F.to_date("o_orderdate").alias("date"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("crop_name"))
    return crops.with_biome(rows, registry.crop_biome(spark), registry.bplut(spark), ["lue_max", "sla", "q10"]).select("sector_id", "date", "crop_name", "biome", "lue_max", "sla", "q10")


@query("request_errors", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Parzelle_' || (row_number() OVER (PARTITION BY c_custkey % 5 = 0 ORDER BY c_custkey) - 1) ELSE 's' || c_custkey END AS sector_id,
      CASE WHEN c_custkey % 3 = 1 THEN 'geometry is a Polygon with a closed ring' WHEN c_custkey % 7 = 2 THEN 'a date range has a start and an end, in order' END AS error FROM customer""")  # fmt: skip
def request_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Many requests, some with an open ring, a reversed range or no name."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "null").otherwise(F.concat(F.lit('"s'), k, F.lit('"')))
    last, first = F.when(k % 3 == 1, "[0, 2]").otherwise("[0, 0]"), F.when(k % 7 == 2, "2019-08-01").otherwise("2019-07-01")
    body = F.concat(
        F.lit('{"number": '), (k + 10**9).cast("string"), F.lit(', "input_data": {"id": {"farm_id": "f", "sector_id": '), name, F.lit('}}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], '), last,
        F.lit(']]}, "requests": {"date_range": ["'), first, F.lit('", "2019-07-15"]}}'),
    )
    return requests.parse_many(read(spark, sf, "customer").select("c_custkey", body.alias("body"))).select("c_custkey", "sector_id", "error")


# Overlay, partitions

def _rectangle_sql(rectangles: Sequence[tuple[float, float, float, float, int]], other: Sequence[tuple[float, float, float, float, int]]) -> str:
    """The signed sum of the overlaps of two lists of boxes beside (a.x, a.y) and (b.x, b.y)."""
    side = lambda v, lo, hi, u, l2, h2: f"greatest(0e0, least(a.{v} + {hi}e0, b.{u} + {h2}e0) - greatest(a.{v} + {lo}e0, b.{u} + {l2}e0))"
    return " + ".join(f"{s * t} * {side('x', x0, x1, 'x', u0, u1)} * {side('y', y0, y1, 'y', v0, v1)}" for x0, y0, x1, y1, s in rectangles for u0, v0, u1, v1, t in other)


_FRAME, _ELL = [(0.0, 0.0, 3.0, 3.0, 1), (1.0, 1.0, 2.0, 2.0, -1)], [(0.0, 0.0, 2.0, 1.0, 1), (0.0, 1.0, 1.0, 2.0, 1)]


@query("polygon_overlay", f"""
    WITH a AS (SELECT s_suppkey AS id, s_suppkey * 3 % 40 + 0.3e0 AS x, s_suppkey // 2 + 0.25e0 AS y FROM supplier),
    b AS (SELECT c_custkey AS area_id, (c_custkey % 40)::DOUBLE AS x, (c_custkey // 40)::DOUBLE AS y FROM customer)
    SELECT * FROM (SELECT id, area_id, round({_rectangle_sql(_FRAME, _ELL)}, 6) + 0e0 AS area FROM a JOIN b ON b.x BETWEEN a.x - 2 AND a.x + 3 AND b.y BETWEEN a.y - 2 AND a.y + 3) WHERE area > 0""")  # fmt: skip
def polygon_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Frames (a hole) over angles (not convex): the area that each pair has in common."""

    def at(x: Column, y: Column, *rings: Sequence[tuple[float, float]]) -> Column:
        return F.array(*[F.array(*[F.struct((x + float(a)).alias("px"), (y + float(b)).alias("py")) for a, b in ring]) for ring in rings])

    s, c = F.col("s_suppkey"), F.col("c_custkey")
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    frames_ = read(spark, sf, "supplier").select(s.alias("id"), at(s * 3 % 40 + 0.3, F.floor(s / 2) + 0.25, box(0, 0, 3, 3), box(1, 1, 2, 2)).alias("rings"))
    angles = read(spark, sf, "customer").select(c.alias("area_id"), at((c % 40).cast("double"), F.floor(c / 40).cast("double"), [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]).alias("rings"))
    return rounded(spatial.overlay(frames_, angles, 4.0).select("id", "area_id", "area"), ["area"])


@query("cache_merge", ORACLE_SQL["upsert_new_wins"].replace("SELECT sector_id, time, y, x,", "SELECT sector_id::VARCHAR AS sector_id, time, y, x,", 1))
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Old rows, then new ones, merged into a cache of partitions, and read back."""
    old, new = _sides(spark, sf)
    cache = partitioned.PartitionedCache(spark, f"{staging.shared_dir(spark)}/cache-{uuid.uuid4().hex}", "sector_id string, time timestamp, y double, x double, v double", buckets=2)
    cache.merge(old)
    cache.merge(new)
    return rounded(cache.read(), ["v"])


# Images

@query("image_png", """
    SELECT l_suppkey % 10 AS image, l_partkey % 40 AS "row", l_orderkey % 50 AS col, max(l_linenumber * 30)::INT AS r, (max(l_quantity) * 5)::INT AS g, (max(l_discount) * 1000)::INT AS b, 255 AS a
    FROM lineitem GROUP BY ALL""")  # fmt: skip
def image_png(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels written as PNG files and read back; those without a row come back transparent and are left out."""
    rows = read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("sector_id"), (F.col("l_partkey") % 40).alias("row"), (F.col("l_orderkey") % 50).alias("col"))
    pixels = rows.agg(F.max(F.col("l_linenumber") * 30).cast("int").alias("r"), (F.max("l_quantity") * 5).cast("int").alias("g"), F.round(F.max("l_discount") * 1000).cast("int").alias("b"), F.lit(255).alias("a"))
    folder = f"{staging.shared_dir(spark)}/images-{uuid.uuid4().hex}"
    images.write_png(pixels, folder)
    got = images.read_png(spark, folder).where("_error is null and a = 255")
    return got.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "r", "g", "b", "a")


# Sources and sinks

def _place(spark: SparkSession, name: str) -> str:
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("retried_downloads", sql("""
    , days AS (SELECT user_id, x0, d, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM gaps)
    SELECT user_id::VARCHAR AS area_id, min(d) AS start, max(d) AS "end", 'done' AS state, sum(CASE WHEN n % 5 = 0 THEN 0 WHEN n % 7 = 0 THEN 2 ELSE 1 END)::BIGINT AS files FROM days GROUP BY user_id, run""".strip(), "parcels"))  # fmt: skip
def retried_downloads(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of a sync whose line breaks once for every request."""
    ledger = _acquired(spark, sf, "leaf_area", "leaf_area", "Flaky")[1]["ledger"]
    return ledger.select("area_id", "start", "end", "state", "files")


@query("request_files", sql(f"SELECT time, y, x, {_IN_RING.format('round(fapar, 6) + 0e0')} AS fapar FROM fapar WHERE sector_id = 3 AND time::DATE BETWEEN DATE '2019-02-01' AND DATE '2019-06-30' AND {_BOX}", "fapar"))
def request_files(spark: SparkSession, sf: str) -> DataFrame:
    """A request's answer saved as GeoTIFF files, and read from them."""
    got = requests.run_request(spark, _body(copernicus_data={"fapar": ["full"]}), {"fapar": fx.fapar(spark, sf)})
    rows = tiff.read_tiffs(spark, requests.save(got, _place(spark, "answer"))["fapar.full"]).where("_error is null")
    time = F.to_timestamp(F.regexp_replace(F.regexp_extract("path", r"fapar_(\d{4}-\d\d-\d\dT[\d-]+)", 1), r"T(\d\d)-(\d\d)-(\d\d)", " $1:$2:$3"))
    return rows.select(time.alias("time"), "y", "x", near("value").alias("fapar"))


@query("saved_csv", "SELECT c_custkey, c_name, round(c_acctbal, 2) + 0e0 AS c_acctbal, c_mktsegment FROM customer")
def saved_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A table saved as CSV with a header, and read back with its types."""
    place = _place(spark, "csv")
    tables.save(read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), place, "csv")
    return rounded(tables.csv(spark, place, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"), ["c_acctbal"], 2)


@query("vector_layers", "SELECT n_nationkey, n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def vector_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Three layers of one data set, joined by the columns they share."""
    place = _place(spark, "layers")
    geo = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    for name, df in (("geo", geo), ("info", read(spark, sf, "nation")), ("legend", read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))):
        tables.save(df, f"{place}/{name}")
    geo, info, legend = tables.layers(spark, place, ["geo", "info", "legend"])
    return frames.natural_left(frames.natural_left(info, legend), geo).groupBy("n_nationkey", "n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("cache_rewrite", sql("SELECT sector_id::VARCHAR AS sector_id, time, y, x, round(fapar + 1, 6) + 0e0 AS fapar FROM fapar", "fapar"))
def cache_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """A cache written from itself."""
    cache = tables.Cache(spark, _place(spark, "whole"), "sector_id string, time timestamp, y double, x double, fapar double", ["sector_id"])
    cache.write(fx.fapar(spark, sf))
    cache.write(cache.read().withColumn("fapar", F.col("fapar") + 1))
    return rounded(cache.read(), ["fapar"])


@query("flat_soil", sql("""
    SELECT f.sector_id, f.time AS date, f.y, f.x, round(f.fapar, 6) + 0e0 AS fapar, round(w.click, 9) + 0e0 AS click, s.clay
    FROM fapar f LEFT JOIN weather_daily w ON w.sector_id = f.sector_id AND w.date = f.time LEFT JOIN (SELECT p_size::BIGINT AS sector_id, count(*) AS clay FROM part GROUP BY 1) s ON s.sector_id = f.sector_id""", "fapar", "weather_daily"))  # fmt: skip
def flat_soil(spark: SparkSession, sf: str) -> DataFrame:
    """All three flat frames, side by side by sector and date."""
    soil = read(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("sector_id")).agg(F.count(F.lit(1)).alias("clay"))
    pixels, daily, background_ = frames.flat_frames([fx.fapar(spark, sf)], fx.weather_daily(spark, sf).select("sector_id", "date", "click"), soil)
    daily = daily.withColumn("date", F.col("date").cast("timestamp"))
    return rounded(rounded(pixels.join(daily, ["sector_id", "date"], "left").join(background_, "sector_id", "left"), ["fapar"]), ["click"], 9)
