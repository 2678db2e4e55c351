"""GeoTIFF rasters: a codec for strips and tiles, a source that reads windows of files, and a writer.

A parcel's file is one row's payload; Spark spreads the files. Large files are read by
:class:`TiffSource`, whose tasks take a share of the tiles that meet the query's box and
read no other bytes. Stored coordinates are the pixels' upper left corners.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

# Tags of the TIFF and GeoTIFF formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 317, 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}
#: Cells of decoded files that a task hands on together.
CELLS = 1 << 18
_CODE = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d"}


@dataclass
class Raster:
    """Bands (band, y, x) with the upper left corner, the steps and the EPSG code."""

    bands: np.ndarray
    x0: float
    y0: float
    dx: float
    dy: float
    crs: int | None = None


def _predicted(rows: np.ndarray) -> bytes:
    """Rows of floats (rows, values) as byte planes, the highest byte first, each byte less the one before it in its row."""
    n, w = rows.shape
    planes = np.ascontiguousarray(rows, rows.dtype.newbyteorder(">")).view(np.uint8).reshape(n, w, -1).transpose(0, 2, 1).reshape(n, -1)
    return np.diff(planes, axis=1, prepend=np.zeros((n, 1), np.uint8)).tobytes()


def encode(r: Raster, tile: int | None = None, deflate: bool = False) -> bytes:
    """A little-endian TIFF of doubles, band after band: one strip a band, or square tiles of ``tile`` cells (a multiple of 16).

    ``deflate``: compressed, after the predictor for floating point.
    """
    n, height, width = r.bands.shape
    w, h = (tile, tile) if tile else (width, height)
    bands = np.full((n, -(-height // h) * h, -(-width // w) * w), np.nan)
    bands[:, :height, :width] = r.bands
    cells = [bands[k, i : i + h, j : j + w] for k in range(n) for i in range(0, bands.shape[1], h) for j in range(0, bands.shape[2], w)]
    blocks = [zlib.compress(_predicted(c)) if deflate else np.ascontiguousarray(c, "<f8").tobytes() for c in cells]
    data = b"".join(b + b"\0" * (len(b) % 2) for b in blocks)
    places = tuple(int(x) for x in 8 + np.cumsum([0, *(len(b) + len(b) % 2 for b in blocks[:-1])]))
    crs_key = 2048 if r.crs == 4326 else 3072
    keys = (1, 1, 0, 3 if r.crs else 1, 1024, 0, 1, 2 if r.crs == 4326 else 1, 1025, 0, 1, 1) + ((crs_key, 0, 1, r.crs) if r.crs else ())
    keys = (1, 1, 0, (len(keys) - 4) // 4, *keys[4:])
    sizes = tuple(map(len, blocks))
    tags = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (64,) * n), (COMPRESSION, 3, (8 if deflate else 1,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (n,)), (PLANAR, 3, (2,)), (FORMAT, 3, (3,) * n),
        (PIXEL_SCALE, 12, (r.dx, r.dy, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, r.x0, r.y0, 0.0)), (GEO_KEYS, 3, keys), (NODATA, 2, b"nan\0"),
        *([(PREDICTOR, 3, (3,))] if deflate else []), *([(TILE_WIDTH, 4, (w,)), (TILE_HEIGHT, 4, (h,)), (TILES, 4, places), (TILE_COUNTS, 4, sizes)] if tile else [(STRIPS, 4, places), (ROWS, 4, (h,)), (COUNTS, 4, sizes)]),
    ]
    at = 8 + len(data)
    directory, extra = struct.pack("<H", len(tags)), b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags, key=lambda t: t[0]):
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_CODE[kind]}", *values)
        if len(raw) <= 4:
            directory += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        else:
            directory += struct.pack("<HHII", tag, kind, len(values), base + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + data + directory + struct.pack("<I", 0) + extra


@dataclass
class Layout:
    """What a file's directory says: the raster's size, where its tiles are and how to read them. A strip is a tile as wide as the raster."""

    width: int
    height: int
    bands: int
    tile_width: int
    tile_height: int
    separate: bool
    places: tuple[int, ...]
    counts: tuple[int, ...]
    compression: int
    predictor: int
    kind: np.dtype
    x0: float
    y0: float
    dx: float
    dy: float
    crs: int | None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)


Read = Callable[[int, int], bytes]


def layout(read: Read) -> Layout:
    """The directory of a TIFF file; ``read`` gives some bytes (offset, size). Raises ValueError for files it can't describe."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack_from(order + "I", head, 4)[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    raw, tags = read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + "HHI", raw, 12 * k)
        size = _SIZE.get(kind, 1) * many
        value = raw[12 * k + 8 : 12 * k + 12] if size <= 4 else read(struct.unpack_from(order + "I", raw, 12 * k + 8)[0], size)
        tags[tag] = value[:size] if kind == 2 else struct.unpack_from(f"{order}{many}{_CODE[kind]}", value) if kind in _CODE else ()
    compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if compression not in (1, 5, 8, 32946, 32773) or predictor not in (1, 2, 3):
        raise ValueError(f"unknown compression {compression} or predictor {predictor}")
    if STRIPS not in tags and TILES not in tags:
        raise ValueError("a TIFF file without strips or tiles")
    width, height, samples, tiled = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0], TILES in tags
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags.get(BITS, (1,))[0] // 8))
    scale, tie, keys = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIE_POINT, (0.0,) * 6), tags.get(GEO_KEYS, ())
    return Layout(
        width, height, samples, tags[TILE_WIDTH][0] if tiled else width, tags[TILE_HEIGHT][0] if tiled else min(height, tags.get(ROWS, (height,))[0]), tags.get(PLANAR, (1,))[0] == 2 and samples > 1,
        tags[TILES if tiled else STRIPS], tags[TILE_COUNTS if tiled else COUNTS], compression, predictor, kind, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1],
        next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (2048, 3072)), None),
    )


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    table, out, width, last = [], bytearray(), 9, b""
    held = bits = 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def tiles(of: Layout, box: Sequence[float] | None = None, bands: Collection[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(number, first band, first row, first column) of the tiles with a cell in a box (x0, y0, x1, y1 of stored coordinates, ends included) and, where bands lie apart, of those bands."""
    rows, columns = (0, of.height - 1), (0, of.width - 1)
    if box is not None:
        span = lambda a, b, n: (int(max(0, math.floor(min(max(a, -1), n)))), int(min(n - 1, math.ceil(max(min(b, n), -1)))))
        columns, rows = span((box[0] - of.x0) / of.dx, (box[2] - of.x0) / of.dx, of.width), span((of.y0 - box[3]) / of.dy, (of.y0 - box[1]) / of.dy, of.height)
    out = []
    for plane in range(of.bands if of.separate else 1):
        if of.separate and bands is not None and plane not in bands:
            continue
        for i in range(rows[0] // of.tile_height, rows[1] // of.tile_height + 1 if rows[0] <= rows[1] else 0):
            for j in range(columns[0] // of.tile_width, columns[1] // of.tile_width + 1 if columns[0] <= columns[1] else 0):
                out.append(((plane * of.down + i) * of.across + j, plane, i * of.tile_height, j * of.tile_width))
    return out


def cells(of: Layout, read: Read, tile: tuple[int, int, int, int]) -> np.ndarray:
    """The values (band, row, column) of a tile as floats, without what lies beyond the raster."""
    number, _, row, column = tile
    raw = read(of.places[number], of.counts[number])
    if of.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif of.compression != 1:
        raw = (_lzw if of.compression == 5 else _packbits)(raw)
    samples, w = 1 if of.separate else of.bands, of.tile_width
    h = min(of.tile_height, len(raw) // (w * samples * of.kind.itemsize))  # the last strip may be short
    if h < min(of.tile_height, of.height - row):
        raise ValueError("a tile of a TIFF file is too short")
    if of.predictor == 3:
        steps = np.frombuffer(raw, np.uint8)[: h * w * samples * of.kind.itemsize].reshape(h, -1, samples)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(h, of.kind.itemsize, w * samples)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(of.kind.newbyteorder(">")).reshape(h, w, samples)
    else:
        values = np.frombuffer(raw, of.kind, h * w * samples).reshape(h, w, samples)
        if of.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=of.kind.newbyteorder("="))
    return values[: of.height - row, : of.width - column].transpose(2, 0, 1).astype(float)


def _bytes(raw: bytes) -> Read:
    def read(at: int, size: int) -> bytes:
        if at + size > len(raw):
            raise ValueError("a TIFF file that ends early")
        return raw[at : at + size]

    return read


def decode(raw: bytes) -> Raster:
    """Read a whole TIFF: strips or tiles, plain or compressed (deflate, LZW, PackBits), with a predictor or without; else ValueError."""
    of, read = layout(_bytes(raw)), _bytes(raw)
    bands = np.full((of.bands, of.height, of.width), np.nan)
    for tile in tiles(of):
        found, (_, band, row, column) = cells(of, read, tile), tile
        bands[band : band + len(found), row : row + found.shape[1], column : column + found.shape[2]] = found
    return Raster(bands, of.x0, of.y0, of.dx, of.dy, of.crs)


def window(read: Read, box: Sequence[float]) -> tuple[Raster, int]:
    """(the part of a file that lies in a box, how many tiles were decoded for it); a raster without cells if nothing does."""
    of = layout(read)
    inside = lambda n, at: [k for k in range(n) if at(k)]
    columns = inside(of.width, lambda c: box[0] <= of.x0 + c * of.dx <= box[2])
    rows = inside(of.height, lambda r: box[1] <= of.y0 - r * of.dy <= box[3])
    if not rows or not columns:
        return Raster(np.full((of.bands, 0, 0), np.nan), of.x0, of.y0, of.dx, of.dy, of.crs), 0
    r0, c0 = rows[0], columns[0]
    bands = np.full((of.bands, len(rows), len(columns)), np.nan)
    wanted = tiles(of, box)
    for tile in wanted:
        found, (_, band, row, column) = cells(of, read, tile), tile
        a, b = max(row, r0), min(row + found.shape[1], r0 + len(rows))
        c, d = max(column, c0), min(column + found.shape[2], c0 + len(columns))
        if a < b and c < d:
            bands[band : band + len(found), a - r0 : b - r0, c - c0 : d - c0] = found[:, a - row : b - row, c - column : d - column]
    return Raster(bands, of.x0 + c0 * of.dx, of.y0 - r0 * of.dy, of.dx, of.dy, of.crs), len(wanted)


def band_names(files: int, bands: int, names: str | list | None = None) -> list[list[str]]:
    """Variable names by file and band: numbered, from a prefix, one a file, or given one by one."""
    if names is None or isinstance(names, str):
        heads = [f"{names or 'value'}_{i}" for i in range(files)]
    elif len(names) != files:
        raise ValueError("one name, or list of names, for each file")
    elif all(isinstance(n, (list, tuple)) for n in names):
        if any(len(n) != bands for n in names):
            raise ValueError("one name for each band")
        return [list(n) for n in names]
    elif all(isinstance(n, str) for n in names):
        heads = list(names)
    else:
        raise ValueError("names are text or lists of text")
    return [[h] if bands == 1 else [f"{h}_band_{j}" for j in range(bands)] for h in heads]


def explode_tiffs(payloads: DataFrame, keys: list[str], content: str = "payload") -> DataFrame:
    """(keys, band, y, x, value, crs) of a column of TIFF files; a file that can't be read gives one row with ``_error``.

    Tables of about ``CELLS`` cells, or of one file, leave a task at a time.
    """
    kinds = dict(payloads.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "band int, y double, x double, value double, crs int, _error string"

    def made(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        """Cells (row of the batch, band, y, x, value, crs) of several files; keys stay as they came, so that times have no other range than Spark's."""
        at, band, y, x, value, crs, error = zip(*held, strict=True)
        sizes = [len(v) for v in value]
        values, own = np.concatenate(value), pa.array(np.repeat(at, sizes))
        each = lambda v, kind: pa.array(v, kind).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        bad = each([e is not None for e in error], pa.bool_()).to_numpy(zero_copy_only=False)
        cells_ = [pa.array(np.concatenate(band), pa.int32(), mask=bad), pa.array(np.concatenate(y), mask=bad), pa.array(np.concatenate(x), mask=bad), pa.array(values, mask=np.isnan(values))]
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(own) for k in range(len(keys))], *cells_, each(crs, pa.int32()), each(error, pa.string())], names=[*keys, "band", "y", "x", "value", "crs", "_error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at, raw in enumerate(batch.column(len(keys))):
                try:
                    r = decode(bytes(raw.as_py()))
                    n, height, width = r.bands.shape
                    places = np.indices((n, height, width)).reshape(3, -1)
                    held.append((at, places[0], r.y0 - places[1] * r.dy, r.x0 + places[2] * r.dx, r.bands.ravel(), r.crs, None))
                except (ValueError, struct.error, KeyError, TypeError, zlib.error) as e:
                    held.append((at, [0], [0.0], [0.0], [np.nan], None, str(e)))
                size += len(held[-1][1])
                if size >= CELLS:
                    yield made(batch, held)
                    held, size = [], 0
            if held:
                yield made(batch, held)

    return payloads.select(*keys, content).mapInArrow(run, schema)


def in_memory(cube: DataFrame, value: str, crs: int | None = None) -> DataFrame:
    """(sector_id, time, payload) of a cube (sector_id, time, y, x, value): one file a sector and time, with cells a unit apart. Cells of the same place are bands of it, in any order."""

    def encoded(rows: pa.Table) -> pa.Table:
        y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", value))
        (xs, column), (ys, row) = np.unique(x, return_inverse=True), np.unique(-y, return_inverse=True)
        place = row * len(xs) + column
        order = np.argsort(place, kind="stable")
        band = np.empty(len(place), int)
        band[order] = np.arange(len(place)) - np.searchsorted(place[order], place[order])
        grid = np.full((band.max() + 1, len(ys), len(xs)), np.nan)
        grid[band, row, column] = v
        payload = encode(Raster(grid, float(xs[0]), float(-ys[0]), 1.0, 1.0, crs))
        return pa.table([rows.column("sector_id").slice(0, 1), rows.column("time").slice(0, 1), pa.array([payload], pa.binary())], names=["sector_id", "time", "payload"])

    rows = cube.select(F.col("sector_id").cast("string").alias("sector_id"), F.col("time").cast("timestamp").alias("time"), "y", "x", value)
    return rows.groupBy("sector_id", "time").applyInArrow(encoded, "sector_id string, time timestamp, payload binary")


def read_tiffs(spark: SparkSession, path: str) -> DataFrame:
    """(path, band, y, x, value, crs, _error) of all TIFF files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return explode_tiffs(files.select("path", F.col("content").alias("payload")), ["path"])


class Share(ds.InputPartition):
    """The k-th of n shares of a file's tiles."""

    def __init__(self, path: str, k: int, n: int):
        self.path, self.k, self.n = path, k, n


class TiffReader(ds.DataSourceReader):
    """Reads the tiles that comparisons of x, y and band with numbers leave over."""

    def __init__(self, options: dict):
        self.path, self.share = options["path"], int(options.get("share_bytes", 64 << 20))
        self.box, self.bands, self.decoded = [-math.inf, -math.inf, math.inf, math.inf], None, 0

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        low, high = (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo), (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if column in ("x", "y"):
                k = "xy".index(column)
                self.box[k] = max(self.box[k], f.value) if isinstance(f, low) else self.box[k]
                self.box[k + 2] = min(self.box[k + 2], f.value) if isinstance(f, high) else self.box[k + 2]
            elif column == "band" and isinstance(f, (ds.EqualTo, ds.In)):
                found = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.bands = found if self.bands is None else self.bands & found
            yield f  # cells of the tiles are still Spark's to filter

    def partitions(self) -> list[Share]:
        where, base = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(base)
        files = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.base_name.lower().endswith((".tif", ".tiff"))]
        root = self.path.removesuffix(base) if self.path.endswith(base) else ""
        parts = [(root + f.path, max(1, -(-f.size // self.share))) for f in files]
        return [Share(path, k, n) for path, n in parts for k in range(n)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        where, name = fs.FileSystem.from_uri(partition.path)
        with where.open_input_file(name) as file:
            read = lambda at, size: bytes(file.read_at(size, at))
            try:
                of = layout(read)
                wanted = tiles(of, None if self.box == [-math.inf, -math.inf, math.inf, math.inf] else self.box, self.bands)
                for tile in wanted[len(wanted) * partition.k // partition.n : len(wanted) * (partition.k + 1) // partition.n]:
                    found, (_, first, row, column) = cells(of, read, tile), tile
                    self.decoded += 1
                    band, y, x = (a.ravel() for a in np.indices(found.shape))
                    values, n = found.ravel(), found.size
                    own = {"path": pa.repeat(pa.scalar(partition.path), n), "band": pa.array(first + band, pa.int32()), "y": pa.array(of.y0 - (row + y) * of.dy), "x": pa.array(of.x0 + (column + x) * of.dx)}
                    yield pa.RecordBatch.from_pydict(own | {"value": pa.array(values, mask=np.isnan(values)), "crs": pa.repeat(pa.scalar(of.crs, pa.int32()), n), "_error": pa.nulls(n, pa.string())})
            except (ValueError, struct.error, KeyError, zlib.error) as e:
                if partition.k == 0:
                    none = {c: pa.nulls(1, t) for c, t in (("band", pa.int32()), ("y", pa.float64()), ("x", pa.float64()), ("value", pa.float64()), ("crs", pa.int32()))}
                    yield pa.RecordBatch.from_pydict({"path": pa.array([partition.path])} | none | {"_error": pa.array([str(e)])})


class TiffSource(ds.DataSource):
    """(path, band, y, x, value, crs, _error) of the TIFF files below a path; a file that can't be read gives one row with ``_error``."""

    @classmethod
    def name(cls) -> str:
        return "fieldcube_tiff"

    def schema(self) -> str:
        return "path string, band int, y double, x double, value double, crs int, _error string"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def scan_tiffs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """:class:`TiffSource` for a path; filters on x, y and band decide which tiles are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("fieldcube_tiff").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def write_tiffs(cube: DataFrame, value: str, folder: str, crs: int | None = None, *, tile: int | None = None, deflate: bool = False, grid: tuple[float, float, float, int, int] | None = None) -> DataFrame:
    """(sector_id, time, path): one file a sector and time, as <value>_<timestamp>.tiff in the sector's folder.

    NULL cells are NaN. A file that is there already stays. The grid of a sector and
    time is a parcel's; that is what one task holds. ``grid`` (left, top, step, columns, rows): the
    cells of every file, where they don't follow from its rows; ``tile`` and ``deflate`` as in :func:`encode`.
    """

    def write(rows: pa.Table) -> pa.Table:
        y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", "_v"))
        if grid is None:
            xs, ys = np.unique(x), np.unique(y)[::-1]
        else:
            xs, ys = grid[0] + grid[2] * np.arange(grid[3]), grid[1] - grid[2] * np.arange(grid[4])
        cells = np.full((1, len(ys), len(xs)), np.nan)
        cells[0, len(ys) - 1 - np.searchsorted(ys[::-1], y), np.searchsorted(xs, x)] = v
        step = lambda a: float(abs(a[1] - a[0])) if len(a) > 1 else 1.0
        sector, name = str(rows.column("sector_id")[0].as_py()), rows.column("_name")[0].as_py()
        where, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{sector}/{value}_{name}.tiff"
        if where.get_file_info(path).type == fs.FileType.NotFound:
            where.create_dir(f"{base}/{sector}")
            part = f"{path}.{uuid.uuid4().hex}.part"  # two attempts of a task don't share a file
            with where.open_output_stream(part) as out:
                out.write(encode(Raster(cells, float(xs[0]), float(ys[0]), step(xs), step(ys), crs), tile, deflate))
            where.move(part, path)
        return pa.table([pa.array([sector]), rows.column("time").slice(0, 1), pa.array([path])], names=["sector_id", "time", "path"])

    rows = cube.select(F.col("sector_id").cast("string").alias("sector_id"), F.col("time").cast("timestamp").alias("time"), "y", "x", F.col(value).cast("double").alias("_v"))
    part = F.expr("if(date_format(time, 'SSSSSS') = '000000', '', date_format(time, '.SSSSSS'))")
    rows = rows.withColumn("_name", F.concat(F.date_format("time", "yyyy-MM-dd'T'HH-mm-ss"), part))
    return rows.groupBy("sector_id", "time").applyInArrow(write, "sector_id string, time timestamp, path string")
