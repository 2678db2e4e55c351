"""Acquisition from gaps, grouped parcels, raster windows and derived caches."""

import datetime as dt
import os
import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from fieldcube import schema
from fieldcube.functions import indices
from fieldcube.operators import growth
from fieldcube.operators.components import components
from fieldcube.plans import derived, satellite
from fieldcube.sources import tables, tiff

RINGS = "sector_id string, ring array<struct<px: double, py: double>>"
DAY0 = dt.datetime(2019, 1, 1, tzinfo=dt.UTC)


def box(x, y, w=2.0, h=2.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def day(d):
    return (DAY0 + dt.timedelta(d)).date()


def raster(asked, v, bands):
    xs, ys = [p[0] for r in asked["rings"] for p in r], [p[1] for r in asked["rings"] for p in r]
    x0, y1 = float(np.ceil(min(xs))), float(np.floor(max(ys)))
    shape = (bands, int(y1 - np.ceil(min(ys))) + 1, int(np.floor(max(xs)) - x0) + 1)
    return tiff.encode(tiff.Raster(np.full(shape, v), x0, y1, 1.0, 1.0))


class Counted:
    """Day 1 has two files, day 2 a broken one, day 3 is told to be empty, day 4 has one at midnight, the others none; "down" (area, file) fails as long as the file is there."""

    def __init__(self, options):
        self.options = options

    def fetch(self, asked):
        with open(f"{self.options['log']}/{asked['area_id']}_{asked['start']}_{uuid.uuid4().hex}", "w"):
            pass
        if asked["area_id"] == self.options.get("down") and os.path.exists(f"{self.options['log']}/../down"):
            raise OSError("no network")
        bands = 1 if asked["product"] == "leaf_area" else 13
        plan = {1: [(8, raster(asked, 1.0, bands)), (10, raster(asked, 2.0, bands))], 2: [(9, b"no file")], 3: [(0, None)], 4: [(0, raster(asked, 4.0, bands))]}
        for d, files in plan.items():
            if asked["start"] <= str(day(d)) <= asked["end"]:
                yield from ({"time": DAY0 + dt.timedelta(d, 3600 * h), "payload": p} for h, p in files)


@pytest.fixture
def place(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path


def fetched(place):
    return sorted(f.rsplit("_", 1)[0] for f in os.listdir(place / "log"))


def synced(spark, place, sectors, product="leaf_area", start="2019-01-01", end="2019-01-07", **options):
    store = satellite.Store.at(spark, f"file://{place}/store", product)
    rows = spark.createDataFrame(sectors, RINGS)
    got = satellite.update(store, rows, product, start, end, "tests.test_acquisition:Counted", today="2019-03-01", buffer=0.5, tile=100.0, retries=0, wait=0, log=str(place / "log"), **options)
    return store, got


def test_gaps_are_downloaded_once(spark, place):
    sectors = [("a", box(0.5, 0.5)), ("b", box(50.5, 0.5))]
    store = satellite.Store.at(spark, f"file://{place}/store", "leaf_area")
    store.cube.merge(spark.createDataFrame([("a", DAY0, 1.0, 1.0, 9.0)], store.cube.schema))
    _, got = synced(spark, place, sectors)
    assert fetched(place) == ["a_2019-01-02", "b_2019-01-01"]
    cells = {(r.sector_id, r.time.replace(tzinfo=dt.UTC), r.y, r.x): r.leaf_area for r in got["cube"].collect()}
    noon = DAY0 + dt.timedelta(1, 9 * 3600)  # the middle of two files, of which the later counts
    expected = {(s, t, y, x + x0): v for s, x0 in (("a", 0), ("b", 50)) for t, v in ((noon, 2.0), (DAY0 + dt.timedelta(4), 4.0)) for y in (1.0, 2.0) for x in (1.0, 2.0)}
    assert cells == expected | {("a", DAY0, 1.0, 1.0): 9.0}
    assert sorted((r.sector_id, r.d) for r in got["no_data"].collect()) == [("a", day(d)) for d in (3, 5, 6)] + [("b", day(d)) for d in (0, 3, 5, 6)]
    assert [(r.area_id, r.time.day) for r in got["quarantine"].orderBy("area_id").collect()] == [("a", 3), ("b", 3)]
    assert sorted((r.area_id, r.state, r.files, r.broken, r.attempt) for r in got["ledger"].collect()) == [("a", "done", 4, 1, 1), ("b", "done", 4, 1, 1)]
    _, again = synced(spark, place, sectors)  # only the broken days are gaps still
    assert fetched(place) == ["a_2019-01-02", "a_2019-01-03", "b_2019-01-01", "b_2019-01-03"]
    assert {(r.sector_id, r.time.replace(tzinfo=dt.UTC), r.y, r.x): r.leaf_area for r in again["cube"].collect()} == cells


def test_recent_days_may_still_come(spark, place):
    store = satellite.Store.at(spark, f"file://{place}/store", "leaf_area")
    rows = spark.createDataFrame([("a", box(0.5, 0.5))], RINGS)
    got = satellite.update(store, rows, "leaf_area", "2019-01-01", "2019-01-10", "tests.test_acquisition:Counted", today="2019-01-06", buffer=0.5, log=str(place / "log"))
    assert sorted(r.d for r in got["no_data"].collect()) == [day(0), day(3), day(5)]


def test_lost_run_goes_on_with_its_downloads(spark, place):
    """Downloads that were staged but not worked in aren't made again."""
    sectors = [("a", box(0.5, 0.5))]
    store, got = synced(spark, place, sectors)
    cells, n = sorted(map(tuple, got["cube"].collect()), key=str), len(fetched(place))
    lost = satellite.Store.at(spark, f"file://{place}/other", "leaf_area")
    asked = satellite.areas(spark.createDataFrame(sectors, RINGS), "leaf_area", 0.5, 100.0)
    wanted = satellite.requests(asked, store.cube.read().limit(0).select("sector_id", F.to_date("time").alias("d")), "leaf_area", "2019-01-01", "2019-01-07").withColumn("attempt", F.lit(1))
    lost.staged.write(satellite.fetch(wanted, "tests.test_acquisition:Counted", log=str(place / "log")).join(wanted.drop("rings"), "request_id"))
    assert len(fetched(place)) == n + 1
    got = satellite.update(lost, spark.createDataFrame(sectors, RINGS), "leaf_area", "2019-01-01", "2019-01-07", "tests.test_acquisition:Counted", today="2019-03-01", buffer=0.5, tile=100.0, log=str(place / "log"))
    assert sorted(map(tuple, got["cube"].collect()), key=str) == cells
    assert len(fetched(place)) == n + 2 and fetched(place)[-1] == "a_2019-01-03"  # the broken day alone


def test_failed_requests_stay_gaps(spark, place):
    sectors = [("a", box(0.5, 0.5)), ("b", box(50.5, 0.5))]
    (place / "down").touch()
    for _ in range(3):
        _, got = synced(spark, place, sectors, end="2019-01-02", down="b", max_attempts=2)
    assert fetched(place) == ["a_2019-01-01", "b_2019-01-01", "b_2019-01-01"]  # given up after two
    assert {r.sector_id for r in got["cube"].collect()} == {"a"} and {r.sector_id for r in got["no_data"].collect()} == {"a"}
    assert sorted((r.area_id, r.state, r.attempt, r.error) for r in got["ledger"].collect()) == [("a", "done", 1, None), ("b", "failed", 1, "no network"), ("b", "failed", 2, "no network")]
    (place / "down").unlink()
    _, got = synced(spark, place, sectors, end="2019-01-02", down="b", max_attempts=5)
    assert {r.sector_id for r in got["cube"].collect()} == {"a", "b"}


def test_touching_parcels_are_one_request(spark, place):
    """Three in a chain and one apart: two requests, and each parcel gets its own cells; a parcel that has a day keeps it."""
    sectors = [("a", box(0.5, 0.5)), ("b", box(3.5, 0.5)), ("c", box(6.5, 0.5)), ("z", box(50.5, 0.5))]
    store = satellite.Store.at(spark, f"file://{place}/store", "bands")
    store.cube.merge(spark.createDataFrame([("b", DAY0 + dt.timedelta(4), 1.0, 4.0, *[7.0] * 13)], store.cube.schema))
    store, got = synced(spark, place, sectors, "bands")
    assert fetched(place) == ["a_2019-01-01", "z_2019-01-01"]
    found = {}
    for r in got["cube"].collect():
        found.setdefault((r.sector_id, r.time.day), set()).add((r.x, r.wvp))
    places = {"a": (1.0, 2.0), "b": (4.0, 5.0), "c": (7.0, 8.0), "z": (51.0, 52.0)}
    assert found == {(s, d): {(x, v) for x in xs} for s, xs in places.items() for d, v in ((2, 2.0), (5, 4.0))} | {("b", 5): {(4.0, 7.0)}}
    small = satellite.areas(spark.createDataFrame(sectors, RINGS), "bands", 0.5, 4.0).collect()  # small tiles part the chain
    assert {r.sector_id: r.area_id for r in small} == {"a": "a", "b": "a", "c": "c", "z": "z"}


def test_components(spark):
    pick = random.Random(8)
    links = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(100)] + [(i, 5000) for i in range(6000, 6200)] + [(None, 1), (9000, 9000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Rasters


def tagged(raw, changes):
    """A file of one strip with other tags: only values that fit in the directory."""
    import struct

    raw = bytearray(raw)
    at = struct.unpack_from("<I", raw, 4)[0]
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag = struct.unpack_from("<H", raw, at + 2 + 12 * k)[0]
        if tag in changes:
            struct.pack_into("<HHII", raw, at + 2 + 12 * k, tag, 4, 1, changes[tag])
    return bytes(raw)


def lzw(data):
    """Codes of 9 to 12 bits, the table cleared when it is full."""
    bits, width, table, word = "", 9, {bytes((i,)): i for i in range(256)}, b""
    size, out = 258, []
    out.append((256, 9))
    for i in data:
        if word + bytes((i,)) in table:
            word += bytes((i,))
            continue
        out.append((table[word], width))
        table[word + bytes((i,))], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes((i,))
        if size == 4094:
            out.append((table[word], width))
            out.append((256, width))
            table, size, width, word = {bytes((i,)): i for i in range(256)}, 258, 9, b""
    if word:
        out.append((table[word], width))
    out.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


BANDS = np.random.default_rng(0).random((3, 50, 70))
BANDS[0, 3, 4] = np.nan


@pytest.mark.parametrize("tile", [None, 16, 32])
@pytest.mark.parametrize("deflate", [False, True])
def test_tiles_and_windows(tile, deflate):
    raw = tiff.encode(tiff.Raster(BANDS, 10.0, 100.0, 0.5, 0.25, 32632), tile, deflate)
    got = tiff.decode(raw)
    assert np.array_equal(got.bands, BANDS, equal_nan=True) and (got.x0, got.y0, got.dx, got.dy, got.crs) == (10.0, 100.0, 0.5, 0.25, 32632)
    xs, ys = 10 + np.arange(70) * 0.5, 100 - np.arange(50) * 0.25
    read, pick = tiff._bytes(raw), random.Random(3)
    for _ in range(60):
        x, y = sorted(pick.uniform(5, 50) for _ in "ab"), sorted(pick.uniform(85, 105) for _ in "ab")
        part, n = tiff.window(read, (x[0], y[0], x[1], y[1]))
        assert np.array_equal(part.bands.reshape(3, -1), BANDS[:, (ys >= y[0]) & (ys <= y[1])][:, :, (xs >= x[0]) & (xs <= x[1])].reshape(3, -1), equal_nan=True)
        assert n <= len(tiff.tiles(tiff.layout(read)))
    assert tile is None or tiff.window(read, (12.0, 99.0, 12.4, 99.5))[1] == 3  # a tile a band


def test_other_compressions():
    """LZW, PackBits, and the predictor of whole numbers, on a file of bytes."""
    grid = (np.arange(300)[:, None] * 7 + np.arange(40)[None, :] ** 2 // 9).astype(np.uint8)
    plain = tiff.encode(tiff.Raster(np.zeros((1, 300, 40)), 0.0, 0.0, 1.0, 1.0))
    for code, packed in ((5, lzw(grid.tobytes())), (32773, b"".join(bytes((39,)) + r.tobytes() for r in grid) + bytes((128,))), (8, zlib.compress(grid.tobytes()))):
        raw = plain + packed
        done = tagged(raw, {tiff.COMPRESSION: code, tiff.STRIPS: len(plain), tiff.COUNTS: len(packed), tiff.BITS: 8, tiff.FORMAT: 1})
        assert np.array_equal(tiff.decode(done).bands[0], grid)
    packbits = bytes((254, 7, 1, 1, 2))
    assert tiff._packbits(packbits) == bytes((7, 7, 7, 1, 2))
    less = np.diff(grid, axis=1, prepend=np.zeros((300, 1), np.uint8)).tobytes()
    of = tiff.layout(tiff._bytes(tagged(plain + less, {tiff.STRIPS: len(plain), tiff.COUNTS: len(less), tiff.BITS: 8, tiff.FORMAT: 1})))
    of.predictor = 2
    assert np.array_equal(tiff.cells(of, tiff._bytes(plain + less), (0, 0, 0, 0))[0], grid)
    for bad in (b"", b"II*\0", plain[:200], tagged(plain, {tiff.COMPRESSION: 7}), plain.replace(b"II*\0", b"II+\0")):
        with pytest.raises(ValueError, match="TIFF|compression"):
            tiff.decode(bad)


def test_source_reads_the_tiles_of_the_box(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.tiff").write_bytes(tiff.encode(tiff.Raster(BANDS, 10.0, 100.0, 0.5, 0.25, 32632), 16, True))
    (tmp_path / "two.tif").write_bytes(b"no file")
    (tmp_path / "notes.txt").write_bytes(b"no raster")
    rows = tiff.scan_tiffs(spark, f"file://{tmp_path}", share_bytes="20000")
    assert rows.where("_error is not null").count() == 1 and rows.where("_error is null").count() == BANDS.size
    got = {(r.band, r.y, r.x): r.value for r in rows.where("x between 12 and 14 and y > 98 and band in (0, 2)").collect()}
    assert got == {(b, 100 - 0.25 * i, 10 + 0.5 * j): None if np.isnan(BANDS[b, i, j]) else BANDS[b, i, j] for b in (0, 2) for i in range(8) for j in range(4, 9)}
    reader = tiff.TiffReader({"path": f"file://{tmp_path}/a"})
    asked = [ds.GreaterThanOrEqual(("x",), 12.0), ds.LessThanOrEqual(("x",), 14.0), ds.GreaterThan(("y",), 98.0), ds.In(("band",), (0, 2))]
    assert list(reader.pushFilters(asked)) == asked  # Spark filters the tiles' cells
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * 256 and reader.decoded == 2  # of 60 tiles


# Derived caches


def sparse(spark, days, cells=6, seed=1, sectors=("s", "t")):
    pick = random.Random(seed)
    rows = [(s, DAY0 + dt.timedelta(d, 3600 * 10), float(c % 2), float(c // 2), pick.random()) for s in sectors for d in days for c in range(cells) if pick.random() < 0.8]
    return spark.createDataFrame(rows, "sector_id string, time timestamp, y double, x double, ndvi double")


def result(df):
    return {(r.sector_id, r.time, r.y, r.x): None if r.ags is None else round(r.ags, 9) for r in df.collect()}


def after(cached, done, gone):
    """The cache without what is gone, with what was computed."""
    return cached.join(gone, gone.columns, "left_anti").unionByName(done)


def test_growth_after_random_arrivals(spark):
    """Equal to growth from scratch, and only what the windows reach is computed."""
    whole = sparse(spark, range(0, 400, 3))
    pick = random.Random(5)
    came = [DAY0 + dt.timedelta(d, 3600 * 10) for d in sorted(pick.sample(range(0, 400, 3), 4))]
    late = F.col("time").isin(came) & (F.col("sector_id") == "s")
    before = whole.where(~late)
    changed = whole.where(late).select("sector_id", "time").distinct()
    cached = growth.rolling_growth(before)
    done, gone = growth.refreshed(whole, cached, changed)
    assert result(after(cached, done, gone)) == result(growth.rolling_growth(whole))
    reach = {r.time for r in done.collect()}
    assert reach == {r.time for r in whole.where("sector_id = 's'").select("time").distinct().collect() if any(c - dt.timedelta(60) < r.time.replace(tzinfo=dt.UTC) <= c + dt.timedelta(30) for c in came)}
    assert {r.sector_id for r in done.collect()} == {"s"}
    # the same days leave again, and with them nothing else
    now = growth.rolling_growth(whole)
    assert result(after(now, *growth.refreshed(before, now, changed))) == result(cached)


def test_growth_of_a_new_pixel(spark):
    whole = sparse(spark, range(0, 200, 4), 5).unionByName(spark.createDataFrame([("s", DAY0 + dt.timedelta(100, 36000), 9.0, 9.0, 0.5)], "sector_id string, time timestamp, y double, x double, ndvi double"))
    before = whole.where("x < 9")
    changed = whole.where("x = 9").select("sector_id", "time")
    first, now = growth.rolling_growth(before), growth.rolling_growth(whole)
    assert result(after(first, *growth.refreshed(whole, first, changed))) == result(now)
    assert result(after(now, *growth.refreshed(before, now, changed))) == result(first)


def test_derived_caches(spark, tmp_path):
    rows = sparse(spark, range(0, 150, 3)).select("sector_id", "time", "y", "x", (F.col("ndvi") * F.col("ndvi") / 2).alias("b04"), F.col("ndvi").alias("b08"), (F.col("ndvi") / 3).alias("b11"))
    store = derived.Derived.at(spark, f"file://{tmp_path}", ["ndmi"])
    derived.refresh(store, rows.where("x < 2 or sector_id = 't'").where("day(time) <> 9"))
    got = derived.refresh(store, rows)
    assert result(got["growth"]) == result(growth.rolling_growth(indices.composites(rows, ["ndvi"])))
    assert got["composites"].count() == rows.count() and got["composites"].where("ndmi is null").count() == 0
    assert derived.refresh(store, rows)["computed"].count() == 0
    changed = rows.withColumn("b08", F.when(F.to_date("time") == "2019-02-03", F.col("b08") + 1).otherwise(F.col("b08")))
    got = derived.refresh(store, changed, replaced=changed.where("date(time) = '2019-02-03'"))
    assert result(got["growth"]) == result(growth.rolling_growth(indices.composites(changed, ["ndvi"])))
    assert 0 < got["computed"].count() < got["growth"].count()
    fewer = rows.where("x < 2 and date(time) <> '2019-05-01'")  # pixels and an instant go
    got = derived.refresh(store, fewer, replaced=rows.where("date(time) = '2019-02-03'"))
    assert result(got["growth"]) == result(growth.rolling_growth(indices.composites(fewer, ["ndvi"])))
    assert got["composites"].count() == fewer.count()


def test_cache_keeps_its_types(spark, tmp_path):
    cache = tables.Cache(spark, f"file://{tmp_path}/c", schema.NO_DATA)
    cache.write(spark.createDataFrame([(1, "p", "2019-01-01", "more")], "sector_id long, product string, d string, other string"))
    assert [tuple(r) for r in cache.read().collect()] == [("1", "p", day(0))]
