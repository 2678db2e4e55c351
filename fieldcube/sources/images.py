"""Images of parcels: PNG files, a sink that writes them, and the download of a parcel's picture in tiles.

An image is rows of pixels (sector_id, row, col, r, g, b, a). A sink's task gets whole
images in order and holds one of them packed; its files count once the job commits.
"""

from __future__ import annotations

import importlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcube import schema
from fieldcube.functions import geometry as g
from fieldcube.functions import scalars
from fieldcube.sources.providers import retried

# The format's first bytes, and its color types by number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOR = {1: 0, 2: 4, 3: 2, 4: 6}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c)).astype(np.uint8)


def filtered(pixels: np.ndarray) -> bytes:
    """Rows (row, column, channel) of bytes, each with the one of the five filters whose differences are smallest."""
    height, width, n = pixels.shape
    rows = pixels.reshape(height, width * n)
    left = np.concatenate([np.zeros((height, n), np.uint8), rows[:, :-n]], 1)
    up = np.concatenate([np.zeros((1, width * n), np.uint8), rows[:-1]])
    corner = np.concatenate([np.zeros((height, n), np.uint8), up[:, :-n]], 1)
    half = ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    tries = np.stack([rows, rows - left, rows - up, rows - half, rows - _paeth(left, up, corner)])
    best = np.abs(tries.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    return np.concatenate([best[:, None].astype(np.uint8), tries[best, np.arange(height)]], 1).tobytes()


def encode(pixels: np.ndarray) -> bytes:
    """A PNG file of (row, column, channel) bytes: gray, gray and alpha, RGB or RGBA."""
    height, width, n = pixels.shape
    head = struct.pack(">IIBBBBB", width, height, 8, COLOR[n], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(pixels))) + _chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    """(row, column, channel) of a PNG file with eight bits a channel and no interlacing; ValueError for others and broken ones."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, head, data, ended = 8, None, b"", False
    while at + 12 <= len(raw) and not ended:
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(raw) < at + 12 + size or struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a broken PNG file")
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        ended, at = kind == b"IEND", at + 12 + size
    channels = {v: k for k, v in COLOR.items()}
    if head is None or not ended:
        raise ValueError("a broken PNG file")
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or color not in channels or interlaced:
        raise ValueError("only PNG files of eight bits without palette and interlacing")
    n = channels[color]
    try:
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    except zlib.error as e:
        raise ValueError("a broken PNG file") from e
    out, up = np.empty((height, width * n), np.uint8), np.zeros(width * n, np.uint8)
    for i, row in enumerate(rows):
        kind, line = row[0], row[1:]
        if kind == 1:
            line = np.cumsum(line.reshape(width, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            line = _unfiltered(line, up, n, kind)
        elif kind:
            raise ValueError("a broken PNG file")
        out[i] = up = line
    return out.reshape(height, width, n)


def _unfiltered(line: np.ndarray, up: np.ndarray, n: int, kind: int) -> np.ndarray:
    """A row whose filter needs the pixel before it (mean of left and upper, or Paeth's choice)."""
    got, above = [0] * n + line.tolist(), [0] * n + up.tolist()
    for i in range(n, len(got)):
        a, b, c = got[i - n], above[i], above[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        got[i] = (got[i] + guess) & 255
    return np.array(got[n:], np.uint8)


# Sink


@dataclass
class Written(ds.WriterCommitMessage):
    """A task's files: (temporary name, final name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class PngWriter(ds.DataSourceArrowWriter):
    """One file an image, named by its sector. Files are written aside and moved when all tasks are done; an aborted job leaves none."""

    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _aside(self, base: str) -> str:
        return f"{base}/_temporary-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = fs.FileSystem.from_uri(self.path)
        done, sector, rows = Written(), None, []

        def flush() -> None:
            if not rows:
                return
            cells = np.concatenate(rows)
            pixels = np.zeros((cells[:, 0].max() + 1, cells[:, 1].max() + 1, 4), np.uint8)
            pixels[cells[:, 0], cells[:, 1]] = cells[:, 2:]
            name = f"{self._aside(base)}/{uuid.uuid4().hex}.png"
            where.create_dir(self._aside(base))
            with where.open_output_stream(name) as out:
                out.write(encode(pixels))
            done.files.append((name, f"{base}/{quote(sector, safe='')}.png"))

        for batch in iterator:
            names = batch.column("sector_id").to_pylist()
            cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "col", "r", "g", "b", "a")], 1)
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a < b and names[a] != sector:
                    flush()
                    sector, rows = names[a], []
                rows += [cells[a:b]] if a < b else []
        flush()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        where, base = fs.FileSystem.from_uri(self.path)
        for part, name in (f for m in messages if m is not None for f in m.files):
            where.move(part, name)
        self._clear(where, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, where: fs.FileSystem, base: str) -> None:
        if where.get_file_info(self._aside(base)).type == fs.FileType.Directory:
            where.delete_dir(self._aside(base))


class PngSource(ds.DataSource):
    """A sink for pixels as PNG files: ``write.format("fieldcube_png").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "fieldcube_png"

    def schema(self) -> str:
        return schema.IMAGE

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"])


def write_png(pixels: DataFrame, folder: str) -> None:
    """Write images; rows and columns count from 0, pixels without a row are transparent. An image of a sector that is there already is replaced. Rows without a sector, row or column are refused."""
    spark = pixels.sparkSession
    spark.dataSource.register(PngSource)
    channel = lambda c, default: F.coalesce(F.greatest(F.least(F.col(c), F.lit(255)), F.lit(0)), F.lit(default)).cast("int").alias(c)
    place = [F.coalesce(F.col(c).cast("int"), F.raise_error(F.lit(f"a pixel without {c}")).cast("int")).alias(c) for c in ("row", "col")]
    sector = F.coalesce(F.col("sector_id").cast("string"), F.raise_error(F.lit("a pixel without sector"))).alias("sector_id")
    rows = pixels.select(sector, *place, channel("r", 0), channel("g", 0), channel("b", 0), channel("a", 255))
    rows.repartition("sector_id").sortWithinPartitions("sector_id").write.format("fieldcube_png").mode("append").save(folder)


def explode_png(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, row, col, r, g, b, a, _error) of a column of PNG files; gray ones have equal channels, those without alpha 255. A file that can't be read gives one row with ``_error``."""
    kinds = files.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k) for k in range(len(keys))]
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    pixels = decode(raw or b"")
                    n = pixels.shape[2]
                    rgb = pixels[..., :3] if n > 2 else np.repeat(pixels[..., :1], 3, axis=2)
                    alpha = pixels[..., -1:] if n in (2, 4) else np.full_like(pixels[..., :1], 255)
                    row, col = (a.ravel() for a in np.indices(pixels.shape[:2]))
                    values = [row, col, *np.concatenate([rgb, alpha], 2).reshape(-1, 4).T]
                    cells, error = [pa.array(v.astype(np.int32)) for v in values], pa.nulls(row.size, pa.string())
                except ValueError as e:
                    cells, error = [pa.nulls(1, pa.int32())] * 6, pa.array([str(e)])
                yield pa.RecordBatch.from_arrays([*(pa.repeat(c[i], len(error)) for c in own), *cells, error], names=[*keys, "row", "col", "r", "g", "b", "a", "_error"])

    empty = "row int, col int, r int, g int, b int, a int, _error string"
    return files.select(*keys, content).mapInArrow(run, _schema(kinds, empty))


def _schema(kinds: T.StructType, more: str) -> T.StructType:
    return T.StructType([*kinds.fields, *T.StructType.fromDDL(more).fields])


def read_png(spark: SparkSession, folder: str) -> DataFrame:
    """(path, row, col, r, g, b, a, _error) of the PNG files of a folder."""
    return explode_png(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder), ["path"])


# Download


def export_tiles(sectors: DataFrame, max_size: int, tile: int = 256) -> DataFrame:
    """(sector_id, width, height, row, col, w, h, x0, y0, x1, y1): the parts of at most ``tile`` pixels a side of each parcel's picture, and their boxes in degrees.

    The picture is the box of ``ring``, north up, its longer side ``max_size``.
    """
    x0, y0, x1, y1 = g.bounds(F.col("ring"))
    width, height = scalars.image_size(x1 - x0, y1 - y0, max_size)
    one = lambda c: F.greatest(c, F.lit(1)).cast("int")
    rows = sectors.select("sector_id", x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"), one(width).alias("width"), one(height).alias("height"))
    starts = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1, F.lit(tile)))
    cut = rows.withColumn("row", starts("height")).withColumn("col", starts("width"))
    cut = cut.withColumns({"w": F.least(F.lit(tile), F.col("width") - F.col("col")), "h": F.least(F.lit(tile), F.col("height") - F.col("row"))})
    dx, dy = (F.col("_x1") - F.col("_x0")) / F.col("width"), (F.col("_y1") - F.col("_y0")) / F.col("height")
    box = {"x0": F.col("_x0") + F.col("col") * dx, "x1": F.col("_x0") + (F.col("col") + F.col("w")) * dx, "y0": F.col("_y1") - (F.col("row") + F.col("h")) * dy, "y1": F.col("_y1") - F.col("row") * dy}
    return cut.select("sector_id", "width", "height", "row", "col", "w", "h", *[v.alias(k) for k, v in box.items()])


def fetch_images(sectors: DataFrame, transport: str, max_size: int = 512, *, tile: int = 256, retries: int = 1, wait: float = 5.0, border: float = 0.0, **options: str) -> DataFrame:
    """(sector_id, row, col, r, g, b, a): the picture of each parcel (sector_id, ring in degrees), put together from exported tiles.

    ``border`` metres around the ring are shown, too; alpha is 255 inside the ring and 0
    outside. ``transport`` ("module:Class") has ``export(asked)``: bbox, width and height to PNG
    bytes of that size. A tile that can't be had, or has another size, fails the job.
    """
    ring = g.buffered_degrees(F.col("ring"), F.lit(border)) if border else F.col("ring")
    parts = export_tiles(sectors.select("sector_id", ring.alias("ring")), max_size, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = transport.partition(":")
        line = getattr(importlib.import_module(module), name)(options)
        for batch in batches:
            for i, part in enumerate(batch.to_pylist()):
                asked: Mapping = {"bbox": (part["x0"], part["y0"], part["x1"], part["y1"]), "width": part["w"], "height": part["h"]} | options
                content = pa.array([retried(lambda asked=asked: line.export(asked), retries, wait)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in kept), content], names=[*kept, "content"])

    kept = ("sector_id", "row", "col", "w", "h")
    kinds = parts.select(*kept).schema
    got = parts.repartition("sector_id", "row", "col").mapInArrow(run, _schema(kinds, "content binary"))
    named = got.withColumnsRenamed({"row": "_row", "col": "_col"})
    cells = explode_png(named, ["sector_id", "_row", "_col", "w", "h"])
    bad = F.col("_error").isNotNull() | (F.col("row") >= F.col("h")) | (F.col("col") >= F.col("w"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("an exported tile isn't the picture asked for: "), F.coalesce("_error", F.lit("its size")))).cast("int")).otherwise(F.col("_row") + F.col("row"))
    pixels = cells.select("sector_id", checked.alias("row"), (F.col("_col") + F.col("col")).alias("col"), "r", "g", "b")
    box = g.bounds(ring)
    size = scalars.image_size(box[2] - box[0], box[3] - box[1], max_size)
    places = sectors.select("sector_id", F.col("ring"), *[b.alias(k) for k, b in zip(("_x0", "_y0", "_x1", "_y1"), box, strict=True)], *[F.greatest(s, F.lit(1)).alias(k) for k, s in zip(("_w", "_h"), size, strict=True)])
    x = F.col("_x0") + (F.col("col") + 0.5) / F.col("_w") * (F.col("_x1") - F.col("_x0"))
    y = F.col("_y1") - (F.col("row") + 0.5) / F.col("_h") * (F.col("_y1") - F.col("_y0"))
    inside = g.in_ring(x, y, F.col("ring"))
    return pixels.join(places, "sector_id").select("sector_id", "row", "col", "r", "g", "b", F.when(inside, 255).otherwise(0).alias("a"))
