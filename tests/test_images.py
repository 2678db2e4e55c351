"""PNG files there and back, the sink's commit and abort, and pictures put together from tiles."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcube import schema
from fieldcube.sources import images

RINGS = "sector_id string, ring array<struct<px: double, py: double>>"


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_there_and_back(channels):
    rng = np.random.default_rng(channels)
    smooth = np.add.outer(np.arange(40), np.arange(60))[..., None] * np.arange(1, channels + 1) % 256
    for pixels in (rng.integers(0, 256, (17, 23, channels)), smooth, np.zeros((1, 1, channels)), np.full((5, 1, channels), 200)):
        raw = images.encode(pixels.astype(np.uint8))
        assert np.array_equal(images.decode(raw), pixels)
        width, height = struct.unpack(">II", raw[16:24])
        assert (height, width) == pixels.shape[:2]


def test_every_filter_is_read():
    """Files of one filter each, made by loops over bytes as the format says."""
    pixels = np.random.default_rng(7).integers(0, 256, (9, 8, 3)).astype(int)
    flat = pixels.reshape(9, 24)
    at = lambda i, j: flat[i][j] if i >= 0 and j >= 0 else 0

    def paeth(a, b, c):
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

    guess = [lambda i, j: 0, lambda i, j: at(i, j - 3), lambda i, j: at(i - 1, j), lambda i, j: (at(i, j - 3) + at(i - 1, j)) // 2, lambda i, j: paeth(at(i, j - 3), at(i - 1, j), at(i - 1, j - 3))]
    for kind in range(5):
        rows = b"".join(bytes([kind, *((flat[i][j] - guess[kind](i, j)) % 256 for j in range(24))]) for i in range(9))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        packed = zlib.compress(rows)
        raw = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", packed[:20]) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")
        assert np.array_equal(images.decode(raw), pixels)
    assert {images.filtered(p.astype(np.uint8))[0] for p in (np.full((2, 9, 3), 9), np.zeros((1, 4, 1)))} <= {0, 1, 2, 3, 4}
    for bad in (b"", raw[:40], raw[:-12], raw.replace(b"tEXt", b"tEXu"), images.SIGNATURE):
        with pytest.raises(ValueError, match="PNG"):
            images.decode(bad)


def test_sink(spark, tmp_path):
    rows = [(s, i, j, i, j, 7, 255 if i else 0) for s in ("a/b", "c") for i in range(3) for j in range(4) if (i, j) != (1, 1)]
    images.write_png(spark.createDataFrame(rows, schema.IMAGE), f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["a%2Fb.png", "c.png"]
    got = images.read_png(spark, f"file://{tmp_path}/out").where("path like '%c.png'")
    assert {tuple(r)[1:7] for r in got.collect()} == {r[1:] for r in rows if r[0] == "c"} | {(1, 1, 0, 0, 0, 0)}
    images.write_png(spark.createDataFrame([("c", 0, 0, 1, 2, 3, None)], schema.IMAGE), f"file://{tmp_path}/out")
    assert [tuple(r)[1:7] for r in images.read_png(spark, f"file://{tmp_path}/out").where("path like '%c.png'").collect()] == [(0, 0, 1, 2, 3, 255)]
    broken = spark.createDataFrame([("d", 0, 0, 1, 2, 3, 4), ("e", None, 0, 1, 2, 3, 4)], schema.IMAGE)
    with pytest.raises(Exception, match="a pixel without row"):
        images.write_png(broken, f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["a%2Fb.png", "c.png"]  # nothing of a job that failed


def test_abort_leaves_nothing(tmp_path):
    writer = images.PngWriter(f"file://{tmp_path}")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"sector_id": s, "row": 0, "col": c, "r": 1, "g": 2, "b": 3, "a": 4} for s in "xy" for c in (0, 1)])
    done = writer.write(iter([batch.slice(0, 1), batch.slice(1)]))
    assert len(done.files) == 2 and len(os.listdir(tmp_path)) == 1
    writer.abort([done, None])
    assert os.listdir(tmp_path) == []
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(os.listdir(tmp_path)) == ["x.png", "y.png"]


class Map:
    """A picture of the whole plane: red and green follow from the place."""

    def __init__(self, options):
        self.options = options

    def export(self, asked):
        x0, y0, x1, y1 = asked["bbox"]
        w, h = asked["width"], asked["height"]
        assert max(w, h) <= int(self.options["most"])
        x, y = x0 + (np.arange(w) + 0.5) / w * (x1 - x0), y1 - (np.arange(h) + 0.5) / h * (y1 - y0)
        pixels = np.stack([np.tile(x * 20, (h, 1)), np.tile(y[:, None] * 20, (1, w)), np.full((h, w), 9)], 2)
        return images.encode(np.round(pixels).astype(np.uint8))


class Small(Map):
    def export(self, asked):
        return images.encode(np.zeros((asked["height"] + 1, asked["width"], 3), np.uint8))


def test_picture_from_tiles(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    triangle = [(0.0, 0.0), (4.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
    sectors = spark.createDataFrame([("s", ring), ("t", triangle)], RINGS)
    assert {(r.sector_id, r.w, r.h) for r in images.export_tiles(sectors, 100, 30).collect()} >= {("s", 30, 30), ("s", 10, 20), ("t", 20, 10)}
    got = {(r.sector_id, r.row, r.col): (r.r, r.g, r.b, r.a) for r in images.fetch_images(sectors, "tests.test_images:Map", 100, tile=30, most="30").collect()}
    assert len(got) == 100 * 50 + 50 * 100
    for (s, row, col), (r, g, b, a) in got.items():
        size = (10.0, 5.0, 100, 50) if s == "s" else (4.0, 8.0, 50, 100)
        x, y = (col + 0.5) / size[2] * size[0], size[1] - (row + 0.5) / size[3] * size[1]
        assert abs(r - x * 20) <= 0.5 + 1e-6 and abs(g - y * 20) <= 0.5 + 1e-6 and b == 9
        assert a == (255 if s == "s" or y < 8 - 2 * x else 0) or abs(y - 8 + 2 * x) < 1e-9
    wide = images.fetch_images(sectors.where("sector_id = 's'"), "tests.test_images:Map", 60, tile=60, most="60", border=20_000.0).groupBy("a").count().collect()
    assert {r.a for r in wide} == {0, 255}  # what is around the ring is transparent
    with pytest.raises(Exception, match="isn't the picture"):
        images.fetch_images(sectors, "tests.test_images:Small", 20).select(F.sum("row")).collect()
