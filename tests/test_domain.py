"""Operators against hand-computed values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldcube import queries, registry, schema
from fieldcube.functions import geometry as g
from fieldcube.functions import projections
from fieldcube.functions import indices, scalars
from fieldcube.operators import crops, cube, dates, frames, growth, spatial, sync, temporal, weather
from fieldcube.plans import gpp, requests, satellite
from fieldcube.sources import providers, tables, tiff
from fieldcube.streaming import upserts

D = dt.date
CUBE = "sector_id string, time timestamp, y double, x double, v double"


def at(day, hour=0):
    return dt.datetime(2019, 1, 1, hour) + dt.timedelta(days=day)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def calendar(spark, *rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "sector_id string, seq int, crop_name string, plant_time string, harvest_time string")


def points(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_crop_change_points(spark):
    c = calendar(spark, ("weizen", "2018-01-10", "2018-05-10"), ("kartoffeln", "2019-01-01", "2019-07-10"))
    got = points(crops.change_points(c, "Grass", 30), "date", "crop_name")
    assert got == [(D(2018, 1, 10), "weizen"), (D(2018, 5, 10), "Grass"), (D(2019, 1, 1), "kartoffeln"), (D(2019, 7, 10), "Grass")]


def test_short_crop_and_same_day(spark):
    c = calendar(spark, ("a", "2018-01-01", "2018-01-30"), ("b", "2018-03-01", None), ("c", "2018-03-01", None))
    assert points(crops.change_points(c, "Grass", 30), "date", "crop_name") == [(D(2018, 1, 1), "a"), (D(2018, 3, 1), "c")]


def test_harvest_before_planting(spark):
    with pytest.raises(PySparkException):
        crops.change_points(calendar(spark, ("a", "2018-02-01", "2018-01-01"))).collect()


def test_islands(spark):
    days = [(D(2019, 7, d),) for d in range(1, 16) if d not in (4, 9)]
    got = points(dates.islands(spark.createDataFrame([("s", *d) for d in days], "k string, d date"), ["k"]), "start", "end")
    assert got == [(D(2019, 7, 1), D(2019, 7, 3)), (D(2019, 7, 5), D(2019, 7, 8)), (D(2019, 7, 10), D(2019, 7, 15))]


def test_missing_and_have_are_the_calendar(spark):
    have = spark.createDataFrame([("a", D(2024, 1, 2)), ("a", D(2024, 1, 2)), ("b", D(2024, 1, 1))], "k string, d date")
    missing = dates.missing_days(have, have.select("k").distinct(), "2024-01-01", "2024-01-03")
    assert points(missing, "k", "d") == [("a", D(2024, 1, 1)), ("a", D(2024, 1, 3)), ("b", D(2024, 1, 2)), ("b", D(2024, 1, 3))]


def test_ranges():
    assert dates.check_range(["2019-07-01", "2019-07-15"]) == ("2019-07-01", "2019-07-15")
    assert dates.check_range(None, "2024-05-05") == ("2017-01-01", "2024-05-05")
    for bad in (["2019-07-02", "2019-07-01"], ["2019-07-02"]):
        with pytest.raises(ValueError):
            dates.check_range(bad)
    assert dates.split_range("2024-01-01", "2024-01-30", "2024-01-20") == {"archive": ("2024-01-01", "2024-01-14"), "forecast": ("2024-01-15", "2024-01-30")}
    assert dates.split_range("2024-01-01", "2024-01-03", "2024-01-20")["forecast"] is None


def test_same_day_midpoint(spark):
    df = spark.createDataFrame([("s", at(0, 10)), ("s", at(0, 12)), ("s", at(1, 9))], "k string, time timestamp")
    assert points(dates.same_day_midpoint(df, ["k"]), "time") == [(at(0, 11),), (at(1, 9),)]


def test_as_of(spark):
    source = spark.createDataFrame([("s", D(2019, 1, 5), 1.0), ("s", D(2019, 1, 9), 2.0)], "k string, date date, v double")
    targets = spark.createDataFrame([("s", D(2019, 1, d), d) for d in (4, 5, 8, 9, 9)] + [("t", D(2019, 1, 9), 0)], "k string, date date, extra int")
    got = [tuple(r) for r in temporal.as_of(targets, source, ["k"], ["v"]).orderBy("k", "date").collect()]
    assert [(r[0], r[1].day, r[3]) for r in got] == [("s", 4, None), ("s", 5, 1.0), ("s", 8, 1.0), ("s", 9, 2.0), ("s", 9, 2.0), ("t", 9, None)]


def test_interpolation(spark):
    rows = [("s", at(0, 6), 0.0, 0.0, 1.0), ("s", at(2, 6), 0.0, 0.0, 3.0), ("s", at(3, 12), 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, CUBE)
    keys = ["sector_id", "y", "x"]
    assert points(temporal.interpolate_daily(df, keys, "v"), "time", "v") == [(at(0, 6), 1.0), (at(1, 6), 2.0), (at(2, 6), 3.0), (at(3, 6), None)]
    assert points(temporal.interpolate_daily(df, keys, "v", "nearest"), "time", "v")[1] == (at(1, 6), 1.0)
    with pytest.raises(ValueError):
        temporal.interpolate_daily(df, keys, "v", "odd")


def test_cubic_meets_nodes_and_cubics(spark):
    x = np.array([0.0, 1.0, 3.0, 4.0, 6.0])
    f = lambda t: t**3 - 2 * t + 1
    both = temporal.not_a_knot(np.array([x, x]), np.array([f(x), 2 * f(x)]), np.array([5, 5]), np.repeat([0, 1], 7), np.tile(np.arange(7.0), 2), np.array([True, True]), np.array([True, True]))
    assert np.allclose(both, np.concatenate([f(np.arange(7.0)), 2 * f(np.arange(7.0))]))
    df = spark.createDataFrame([("s", at(int(t)), 0.0, 0.0, float(f(t))) for t in x], CUBE)
    got = points(temporal.interpolate_daily(df, ["sector_id"], "v", "cubic"), "time", "v")
    assert np.allclose([v for _, v in got], f(np.arange(7.0)))


def test_long_cubic_series_is_solved_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.choice([0.25, 1.0, 3.0, 40.0], 900))
    x, y = t - t[0], rng.normal(size=900)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((900, 900)), np.zeros(900)
    for i in range(1, 899):
        a[i, i - 1 : i + 2], b[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (d[i] - d[i - 1])
    a[0, :3], a[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
    m = np.linalg.solve(a, b)
    days = np.arange(int(x[-1]) + 1)
    i = np.clip(np.searchsorted(x, days, "right") - 1, 0, 898)
    s = days - x[i]
    dense = y[i] + s * (d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6 + s * (m[i] / 2 + s * (m[i + 1] - m[i]) / (6 * h[i])))
    monkeypatch.setattr(temporal, "CHUNK", 100)
    df = spark.createDataFrame([("s", at(0) + dt.timedelta(days=float(u)), float(v)) for u, v in zip(x, y, strict=True)], "sector_id string, time timestamp, v double")
    got = points(temporal.interpolate_daily(df, ["sector_id"], "v", "cubic"), "time", "v")
    assert [r[0] for r in got] == [at(int(k)) for k in days] and np.allclose([r[1] for r in got], dense, rtol=1e-9, atol=1e-9)


def test_cubic_series_of_all_lengths_together(spark, monkeypatch):
    """Series with their own instants and gaps, solved in blocks, against each one by itself."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        days = np.sort(rng.choice(60, rng.integers(0, 30), replace=False))
        rows += [(k, at(float(d) + 0.5 * (k % 3 == 0)), None if rng.random() < 0.15 else float(rng.normal())) for d in days]
    df = spark.createDataFrame(rows, "sector_id long, time timestamp, v double")
    together = {(r.sector_id, r.time): r.v for r in temporal.interpolate_daily(df, ["sector_id"], "v", "cubic").collect()}
    line = {(r.sector_id, r.time): r.v for r in temporal.interpolate_daily(df, ["sector_id"], "v", "linear").collect()}
    assert {k: v is None for k, v in together.items()} == {k: v is None for k, v in line.items()}
    for k in range(40):
        known = [(t, v) for s, t, v in rows if s == k and v is not None]
        start = min((t for s, t, _ in rows if s == k), default=None)
        x = np.array([(t - start).total_seconds() / 86400 for t, _ in known])
        y = np.array([v for _, v in known])
        for (s, t), v in together.items():
            if s != k or v is None:
                continue
            u = (t - start).total_seconds() / 86400
            if len(x) < 4:
                assert v == pytest.approx(np.polyval(np.polyfit(x, y, len(x) - 1), u), abs=1e-6)
                continue
            a, b, n = np.zeros((len(x), len(x))), np.zeros(len(x)), len(x)
            h, d = np.diff(x), np.diff(y) / np.diff(x)
            for i in range(1, n - 1):
                a[i, i - 1 : i + 2], b[i] = (h[i - 1], 2 * (h[i - 1] + h[i]), h[i]), 6 * (d[i] - d[i - 1])
            a[0, :3], a[-1, -3:] = (h[1], -h[0] - h[1], h[0]), (h[-1], -h[-2] - h[-1], h[-2])
            m = np.linalg.solve(a, b)
            i = int(np.clip(np.searchsorted(x, u, "right") - 1, 0, n - 2))
            w = u - x[i]
            assert v == pytest.approx(y[i] + w * (d[i] - h[i] * (2 * m[i] + m[i + 1]) / 6 + w * (m[i] / 2 + w * (m[i + 1] - m[i]) / (6 * h[i]))), abs=1e-8)


def test_as_of_spreads_a_key(spark):
    """One key with many rows over years: equal to a loop, in many tasks; dates and keys may be NULL."""
    import bisect
    import random

    pick = random.Random(9)
    source = {(k, D(2000, 1, 1) + dt.timedelta(pick.randrange(4000))): float(i) for i, k in enumerate(["hot"] * 400 + ["b", None] * 10)}
    targets = [("hot" if pick.random() < 0.9 else pick.choice(["b", None, "c"]), None if pick.random() < 0.01 else D(2000, 1, 1) + dt.timedelta(pick.randrange(-50, 4100)), i) for i in range(3000)]
    got = temporal.as_of(spark.createDataFrame(targets, "k string, date date, i int"), spark.createDataFrame([(k, d, v) for (k, d), v in source.items()], "k string, date date, v double"), ["k"], ["v"])
    by = {k: sorted((d, v) for (q, d), v in source.items() if q == k) for k in ("hot", "b", None, "c")}
    expected = []
    for k, d, i in targets:
        j = bisect.bisect_right(by[k], (d, 1e9)) if d else 0
        expected.append((i, by[k][j - 1][1] if j else None))
    assert sorted((r.i, r.v) for r in got.collect()) == sorted(expected)
    tasks = got.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    assert queries.QUERIES["polygon_intersects_all"](spark, sf).select("area_id").distinct().count() == spark.read.parquet(f"{sf}/customer.parquet").count() > 400
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    ends = items.groupBy((F.col("l_suppkey") % 20).alias("s")).agg((F.datediff(F.max("l_shipdate"), F.min("l_shipdate")) + 1).alias("n")).agg(F.sum("n")).first()[0]
    for name in ("interp_linear_daily_all", "interp_nearest_daily_all", "interp_cubic_daily"):
        assert queries.QUERIES[name](spark, sf).count() == ends


def test_rolling_growth(spark):
    rows = [("s", at(d), 0.0, 0.0, float(d)) for d in range(0, 120, 3)]
    got = dict(points(growth.rolling_growth(spark.createDataFrame(rows, CUBE), "v"), "time", "ags"))
    assert got[at(30)] == pytest.approx(np.mean(range(60, 90, 3)) - np.mean(range(0, 30, 3)))
    assert got[at(0)] is None and got[at(117)] is None
    few = spark.createDataFrame(rows[::4], CUBE)
    assert {r.ags for r in growth.rolling_growth(few, "v").collect()} == {None}


def test_means_pass_over_missing(spark):
    df = spark.createDataFrame([("s", at(0), 0.0, 0.0, 1.0), ("s", at(0), 0.0, 1.0, None), ("s", at(1), 0.0, 0.0, 3.0)], CUBE)
    assert points(cube.spatial_mean(df), "v") == [(1.0,), (3.0,)]
    assert sorted((r.v is None, r.v) for r in cube.temporal_mean(df).collect()) == [(False, 2.0), (True, None)]
    assert set(cube.summaries(df, ["full", "median"])) == {"full"}
    nan = spark.createDataFrame([("s", at(0), 0.0, 0.0, float("nan"))], CUBE)
    assert scalars.nan_as_null(nan).first().v is None


def test_time_slice_is_closed(spark):
    df = spark.createDataFrame([("s", at(d, 10), 0.0, 0.0, 1.0) for d in range(4)], CUBE)
    assert cube.time_slice(df, "2019-01-02", "2019-01-03").count() == 2
    assert cube.time_slice(df, None, None).count() == 4


def test_indices(spark):
    bands = {b: 0.1 * (i + 1) for i, b in enumerate(("b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12"))}
    df = spark.createDataFrame([("s", at(0), 0.0, 0.0, *bands.values()), ("t", at(0), 0.0, 0.0, *[0.0] * 10)], "sector_id string, time timestamp, y double, x double, " + ", ".join(f"{b} double" for b in bands))
    got = {r.sector_id: r for r in indices.composites(df).collect()}
    b = bands
    assert got["s"].ndvi == pytest.approx((b["b08"] - b["b04"]) / (b["b08"] + b["b04"]))
    assert got["s"].msi == got["s"].ndvi
    assert got["s"].arvi == pytest.approx((b["b8a"] - b["b04"] - 0.106 * (b["b04"] - b["b02"])) / (b["b8a"] + b["b04"] - 0.106 * (b["b04"] - b["b02"])))
    assert got["t"].psri is None and got["t"].ari is None and got["t"].savi == 0


def test_scalars(spark):
    assert one(spark, *[scalars.roof(F.lit(v)) for v in (1.2, 2.0, -1.5)]) == (2, 2, 0)
    assert one(spark, scalars.nodata_as_zero(F.lit(-9999.0)), scalars.nodata_as_zero(F.lit(2.0))) == (0.0, 2.0)
    assert one(spark, scalars.tiff_name(F.lit("ndvi"), F.lit("2019-07-01 10:20:29").cast("timestamp"))) == ("ndvi_2019-07-01T10-20-29.tiff",)


def test_geometry(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    ring = g.ring_literal(square)
    inside = lambda r: one(spark, g.in_ring(F.lit(2.0), F.lit(1.0), r), g.in_ring(F.lit(5.0), F.lit(1.0), r))
    assert inside(square) == inside(ring) == (True, False)
    hole = g.ring_literal([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)])
    assert one(spark, g.in_polygon(F.lit(2.0), F.lit(2.0), F.array(ring, hole)), g.in_polygon(F.lit(0.5), F.lit(2.0), F.array(ring, hole))) == (False, True)
    assert tuple(one(spark, g.centroid(ring))[0]) == (2.0, 2.0)
    wide = one(spark, g.buffered(ring, F.lit(1.0)))[0]
    assert {(p.px, p.py) for p in wide} == {(-1.0, -1.0), (5.0, -1.0), (5.0, 5.0), (-1.0, 5.0)}
    cut = one(spark, g.clipped(ring, [(2, -1), (9, -1), (9, 9), (2, 9), (2, -1)]))[0]
    assert {(p.px, p.py) for p in cut} == {(2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0)}
    assert one(spark, g.clipped(ring, [(20, 0), (30, 0), (30, 9), (20, 9), (20, 0)])) == ([],)
    far = g.ring_literal([(9, 9), (10, 9), (10, 10), (9, 9)])
    assert one(spark, g.rings_intersect(ring, hole), g.rings_intersect(ring, far)) == (True, False)
    e, n = one(spark, *g.utm(F.lit(9.0), F.lit(0.0)))
    assert (round(e, 6), round(n, 6)) == (500000.0, 0.0)
    e, n = one(spark, *g.utm(F.lit(11.3), F.lit(51.8)))
    assert 640000 < e < 670000 and 5.73e6 < n < 5.75e6
    assert one(spark, *g.metres_to_degrees(F.lit(10.0), F.lit(0.0)))[0] == pytest.approx(10 / 6378137 * 180 / math.pi)
    assert one(spark, g.guess_crs(F.lit(11.3), F.lit(51.8)), g.guess_crs(F.lit(660000.0), F.lit(5740000.0))) == (4326, 25832)
    with pytest.raises(PySparkException):
        one(spark, g.guess_crs(F.lit(4345751.0), F.lit(3264282.0)))


def test_point_sample_and_masks(spark):
    df = spark.createDataFrame([("s", at(0), float(y), float(x), float(10 * y + x)) for y in range(3) for x in range(3)], CUBE)
    assert points(spatial.point_sample(df, 1.5, 0.5, ["v"]), "v", "v_mean") == [(11.0, 11.0)]
    assert points(spatial.point_sample(df, -5, 9, ["v"]), "v") == [(20.0,)]
    assert points(spatial.point_sample(df, -5, 9, ["v"], compat=True), "v") == [(0.0,)]
    ring = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]
    assert [r.v for r in spatial.mask(df, ring, ["v"], box=False).where("v is not null").collect()] == [11.0]
    sectors = spark.createDataFrame([("s", [(p[0], p[1]) for p in ring])], "sector_id string, ring array<struct<px: double, py: double>>")
    assert [r.v for r in spatial.mask_by_sector(df, sectors, ["v"]).collect()] == [11.0]


def test_upsert(spark):
    old = spark.createDataFrame([("s", at(0), 0.0, 0.0, 1.0), ("s", at(1), 0.0, 0.0, 1.0)], CUBE)
    new = spark.createDataFrame([("s", at(1), 0.0, 0.0, 2.0), ("s", at(2), 0.0, 0.0, 2.0)], CUBE)
    assert points(sync.upsert(old, new), "v") == [(1.0,), (2.0,), (2.0,)]
    assert points(sync.upsert(old, new, "old"), "v") == [(1.0,), (1.0,), (2.0,)]
    assert points(sync.upsert(old, old), "time", "v") == points(old, "time", "v")
    assert sync.is_subset(old.limit(1), old, "v") and not sync.is_subset(new, old, "v")
    assert sync.sync_cube(old, old.limit(1), "v") is old
    with pytest.raises(ValueError):
        sync.sync_cube(old, new.where("false"), "v")
    wide = spark.createDataFrame([("s", at(5), 0.0, float(x), 1.0) for x in range(9)], CUBE)
    with pytest.raises(ValueError):
        sync.sync_cube(old, wide, "v")
    assert sync.record_no_data(*[spark.createDataFrame([], "sector_id string, product string, d date")] * 2).count() == 0


def test_frames(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    assert frames.merge(None, a) is a and frames.merge(a, None) is a
    assert frames.one_hot(a, ["a"]).columns == ["a_x", "a_y", "k"]
    assert frames.merge(a, spark.createDataFrame([(3, 1.0)], "k int, b double"), "concat").count() == 3
    assert frames.sorted_columns(a, ["k"]).columns == ["k", "a"]


def test_weather_completeness(spark):
    w = spark.createDataFrame([("s", at(0), 1.0, None), ("s", at(1), 1.0, 2.0)], "sector_id string, date timestamp, a double, b double")
    assert points(weather.complete_days(w, ["a", "b"]), "d") == [(D(2019, 1, 2),)]
    assert weather.complete_days(w, ["a", "missing"]).count() == 0
    assert points(weather.gaps({"daily": w}, {"daily": ["a", "b"]}, w, "2019-01-01", "2019-01-03"), "start", "end") == [(D(2019, 1, 1), D(2019, 1, 1)), (D(2019, 1, 3), D(2019, 1, 3))]


def test_gpp(spark):
    fapar = spark.createDataFrame([("s", at(d), 0.0, 0.0, 0.5) for d in (0, 1, 10)], CUBE.replace(" v ", " fapar "))
    par = spark.createDataFrame([("s", D(2019, 1, 2), 10.0)], "sector_id string, date date, par double")
    got = gpp.gpp(fapar, par, calendar(spark, ("weizen", "2019-01-01", None)), registry.crop_biome(spark), registry.bplut(spark))
    assert [r.gpp for r in got.orderBy("time").collect()] == [None, pytest.approx(0.5 * 10 * 0.001044), pytest.approx(0.5 * 10 * 0.001044)]


def test_tiff_codec(spark, tmp_path):
    values = np.arange(24.0).reshape(2, 3, 4)
    values[0, 0, 0] = np.nan
    r = tiff.decode(tiff.encode(tiff.Raster(values, 10.0, 50.0, 0.5, 0.25, 32632)))
    assert np.array_equal(r.bands, values, equal_nan=True) and (r.x0, r.y0, r.dx, r.dy, r.crs) == (10.0, 50.0, 0.5, 0.25, 32632)
    with pytest.raises(ValueError):
        tiff.decode(b"nothing")
    df = spark.createDataFrame([("s", at(0), float(y), float(x), float(10 * y + x) if x else None) for y in range(3) for x in range(2)], CUBE)
    paths = [r.path for r in tiff.write_tiffs(df, "v", f"file://{tmp_path}/out", 4326).collect()]
    assert len(paths) == 1 and paths[0].endswith("s/v_2019-01-01T00-00-00.tiff")
    assert points(tiff.read_tiffs(spark, f"file://{tmp_path}/out").where("value is not null"), "y", "x", "value") == points(df.where("v is not null"), "y", "x", "v")
    bad = spark.createDataFrame([("s", bytearray(b"broken"))], "k string, payload binary")
    assert tiff.explode_tiffs(bad, ["k"]).first()["_error"]
    assert tiff.band_names(2, 1) == [["value_0"], ["value_1"]] and tiff.band_names(1, 2, "p") == [["p_0_band_0", "p_0_band_1"]]
    assert tiff.band_names(2, 1, ["a", "b"]) == [["a"], ["b"]] and tiff.band_names(1, 2, [["a", "b"]]) == [["a", "b"]]
    with pytest.raises(ValueError):
        tiff.band_names(2, 1, ["a"])


class Recorded:
    """A transport with fixed answers."""

    def __init__(self, options):
        self.options = options

    def fetch(self, asked):
        return [{"sector_id": asked["sector_id"], "payload": '{"properties": {"parameter": {"ALLSKY_SFC_PAR_TOT": {"20190102": 7.5}}}}'}]


class Broken(Recorded):
    def fetch(self, asked):
        raise OSError("no network")


def test_providers(spark):
    ranges = [("a", "2019-01-01", "2019-01-02"), ("b", "2019-01-01", "2019-01-02")]
    got = providers.scan(spark, providers.RadiationSource, "tests.test_domain:Recorded", ranges)
    assert points(weather.par_series(got), "sector_id", "date", "par") == [("a", D(2019, 1, 2), 7.5), ("b", D(2019, 1, 2), 7.5)]
    assert providers.scan(spark, providers.RadiationSource, "tests.test_domain:Broken", ranges, wait="0", failures="skip").count() == 0
    with pytest.raises(Exception, match="no network"):
        providers.scan(spark, providers.RadiationSource, "tests.test_domain:Broken", ranges, wait="0").count()


def test_cache_versions(spark, tmp_path):
    cache = tables.Cache(spark, f"file://{tmp_path}/cache", CUBE, ["sector_id"])
    assert cache.read().count() == 0
    cache.write(spark.createDataFrame([("s", at(0), 0.0, 0.0, 1.0)], CUBE))
    cache.write(cache.read().withColumn("v", F.col("v") + 1))
    assert points(cache.read(), "v") == [(2.0,)]


def test_stream_upserts(spark, tmp_path):
    cache = tables.Cache(spark, f"file://{tmp_path}/cache", CUBE)
    spark.createDataFrame([("s", at(0), 0.0, 0.0, 1.0)], CUBE).write.parquet(f"file://{tmp_path}/in")
    arrivals = spark.readStream.schema(CUBE).parquet(f"file://{tmp_path}/in")
    done = upserts.upsert_stream(arrivals, cache).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert points(cache.read(), "v") == [(1.0,)]
    assert upserts.daily_means(arrivals, "v").isStreaming


BODY = {
    "geometry": {"type": "Polygon", "coordinates": [[[-1, -1], [9, -1], [9, 9], [-1, 9], [-1, -1]]]},
    "input_data": {"id": {"sector_id": "s"}, "crop_data": [{"crop_name": "weizen", "plant_time": "2019-01-01"}]},
    "requests": {
        "date_range": ["2019-01-01", "2019-12-31"],
        "copernicus_data": {"fapar": ["spatial_mean"], "composites": {"ndvi": ["full", "temporal_mean"], "ags": ["full"]}},
        "photosynthesis": {"mean": ["spatial_mean"], "interpolation": "linear"},
    },
}


def test_requests(spark):
    fapar = spark.createDataFrame([("s", at(d), 0.0, 0.0, 0.5) for d in (0, 2)], CUBE.replace(" v ", " fapar "))
    bands = fapar.select("sector_id", "time", "y", "x", F.lit(0.1).alias("b04"), F.lit(0.3).alias("b08"))
    par = spark.createDataFrame([("s", D(2019, 1, 1), 10.0)], "sector_id string, date date, par double")
    got = requests.run_request(spark, BODY, {"fapar": fapar, "bands": bands, "par": par})
    assert set(got) == {"fapar.spatial_mean", "ndvi.full", "ndvi.temporal_mean", "ags.full", "gpp.spatial_mean"}
    assert got["gpp.spatial_mean"].count() == 3 and got["ndvi.temporal_mean"].first().ndvi == pytest.approx(0.5)
    for broken in ({}, BODY | {"geometry": {"type": "Point"}}, BODY | {"requests": {"date_range": ["2020-01-01", "2019-01-01"]}}):
        with pytest.raises(requests.RequestError):
            requests.parse(broken)
    with pytest.raises(requests.RequestError):
        requests.run_request(spark, BODY, {"fapar": fapar, "par": par})
    assert requests.parse({**BODY, "input_data": {}}, taken=4).sector_id == "Parzelle_4"


def test_growth_reaches_beyond_the_asked_days(spark):
    """Windows of the whole cache, cut to the asked days afterwards; ring in degrees, cube in UTM."""
    lon, lat = 9.2, 48.7
    east, north = g.utm(lon, lat, m=math)
    bands = spark.createDataFrame([("s", at(3 * d), north, east, 0.1, 0.2 + d / 100) for d in range(60)], "sector_id string, time timestamp, y double, x double, b04 double, b08 double")
    meta = spark.createDataFrame([("s", "bands", 32632)], schema.CUBE_META)
    ring = [[lon - 0.01, lat - 0.01], [lon + 0.01, lat - 0.01], [lon + 0.01, lat + 0.01], [lon - 0.01, lat + 0.01], [lon - 0.01, lat - 0.01]]
    body = BODY | {"geometry": {"type": "Polygon", "coordinates": [ring]}, "requests": {"date_range": ["2019-02-10", "2019-02-24"], "copernicus_data": {"composites": {"ags": ["full"], "ndvi": ["full"]}}}}
    got = requests.run_request(spark, body, {"bands": bands, "cube_meta": meta, "background": spark.createDataFrame([("s", 1.0), ("t", 2.0)], "sector_id string, clay double")})
    rows = got["ags.full"].collect()
    assert len(rows) == 5 and all(r.ags is not None for r in rows) and got["ndvi.full"].count() == 5
    assert [r.clay for r in got["background"].collect()] == [1.0]
    far = [[x + 5, y] for x, y in ring]
    assert requests.run_request(spark, body | {"geometry": {"type": "Polygon", "coordinates": [far]}}, {"bands": bands, "cube_meta": meta})["ndvi.full"].where("ndvi is not null").count() == 0


def test_files_of_a_day_become_one(spark):
    rows = [("s", at(0, 8), 0.0, 0.0, 1.0), ("s", at(0, 10), 0.0, 0.0, 3.0), ("s", at(0, 8), 0.0, 1.0, 5.0), ("s", at(0, 10), 0.0, 1.0, None), ("s", at(1), 0.0, 0.0, 7.0)]
    got = points(satellite.one_time_a_day(spark.createDataFrame(rows, CUBE), ["v"]), "time", "x", "v")
    assert got == [(at(0, 9), 0.0, 3.0), (at(0, 9), 1.0, 5.0), (at(1), 0.0, 7.0)]


def test_utm_there_and_back(spark):
    places = [(9.0, 48.5), (6.1, 0.0), (11.9, -33.0), (8.0, 70.0)]
    for lon, lat in places:
        back = g.lon_lat(*g.utm(lon, lat, m=math), m=math)
        assert back == pytest.approx((lon, lat), abs=1e-8)
    df = spark.createDataFrame(places, "lon double, lat double")
    e, n = g.utm(F.col("lon"), F.col("lat"))
    lon, lat = g.lon_lat(e, n)
    assert all(r.a < 1e-8 and r.b < 1e-8 for r in df.select(F.abs(lon - F.col("lon")).alias("a"), F.abs(lat - F.col("lat")).alias("b")).collect())
    there = projections.ring_in
    assert there([(9.0, 48.5)], 4326) == [(9.0, 48.5)] and there(there([(9.0, 48.5)], 25832), 4326)[0] == pytest.approx((9.0, 48.5))
    for crs in (3857, 3035, 3034, 2154, 32632, 32733):
        assert there(there([(9.0, 48.5), (10.0, 52.0)], crs, 4326), 4326, crs) == [pytest.approx(p, abs=1e-8) for p in ((9.0, 48.5), (10.0, 52.0))]
    assert there(there([(11.9, 48.5)], 32632), 32633, 32632)[0] == pytest.approx(there([(11.9, 48.5)], 32633, 4326)[0], abs=1e-3)
    assert there([(9.0, 48.5)], 3857, 4326)[0] == pytest.approx((1001875.417, 6190443.809), abs=1e-3)
    assert there([(10.0, 52.0)], 3035, 4326)[0] == pytest.approx((4321000.0, 3210000.0), abs=1e-6)
    for odd in ((1e7, 1e7), (-5000.0, 48.5)):
        with pytest.raises(ValueError, match="coordinate"):
            there([odd], 4326)
    with pytest.raises(ValueError, match="EPSG"):
        there([(9.0, 48.5)], 31467)


@pytest.mark.parametrize("method", ["linear", "nearest", "cubic"])
def test_missing_values_mean_the_same(spark, method):
    """A day is NULL beside a missing value, and days count from the sector's first instant, with each method."""
    rows = [("s", 0.0, at(0.25 + 2 * i), None if i == 3 else float(i)) for i in range(8)] + [("s", 1.0, at(0), 1.0), ("s", 1.0, at(9), 2.0)]
    df = spark.createDataFrame(rows, "sector_id string, x double, time timestamp, v double")
    got = {r.time: r.v for r in temporal.interpolate_daily(df, ["sector_id", "x"], "v", method).where("x = 0").collect()}
    assert sorted(got) == [at(d) for d in range(1, 15)]
    assert [t for t, v in sorted(got.items()) if v is None] == [at(d) for d in (5, 6, 7, 8)]


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), None)], "a int, b double, c double, d string")
    assert tables.as_json(df).first().record == '{"a":1,"b":null,"c":null,"d":null}'
