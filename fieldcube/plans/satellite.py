"""Bringing a product's cache up to date, from its gaps to its cells.

The days that parcels lack become a table of requests, one for each run of days and
area; tasks fetch them and what came is staged, written once. Cells, empty days
and broken files are read from there, so a download happens once whatever is made of
it, and a run that was lost after its downloads goes on with what they gave. A
ledger keeps the number of attempts.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcube import registry, schema
from fieldcube.functions import geometry as g
from fieldcube.operators import dates, spatial, sync
from fieldcube.operators.components import components
from fieldcube.sources import tiff
from fieldcube.sources.partitioned import PartitionedCache
from fieldcube.sources.providers import retried
from fieldcube.sources.staging import Staged
from fieldcube.sources.tables import Cache

PIXEL = ["sector_id", "time", "y", "x"]
_FETCHED = pa.schema([("request_id", pa.string()), ("kind", pa.string()), ("time", pa.timestamp("us", "UTC")), ("payload", pa.binary()), ("error", pa.string())])
_BATCH_BYTES = 16 << 20


def one_time_a_day(pixels: DataFrame, values: Sequence[str]) -> DataFrame:
    """Acquisitions of a day as one, at the middle of its first and last instant; of a cell's values the last one counts."""
    instants = pixels.select("sector_id", "time").distinct()
    middle = dates.same_day_midpoint(instants, ["sector_id"]).withColumnRenamed("time", "_time")
    by_day = pixels.withColumn("d", F.to_date("time")).groupBy("sector_id", "d", "y", "x")
    latest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("time"))).alias(v) for v in values]
    return by_day.agg(*latest).join(middle, ["sector_id", "d"]).select("sector_id", F.col("_time").alias("time"), "y", "x", *values)


# What to ask for


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The cells of a grid that a box touches, as an array of (cx, cy)."""
    steps = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(steps(x0, x1), lambda cx: F.transform(steps(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def areas(sectors: DataFrame, product: str, buffer: float, tile: float, metres: float | None = None) -> DataFrame:
    """(sector_id, area_id, ring, asked): the area that a parcel is asked for in, and the ring asked for.

    A product that needs it is asked for with a mitred buffer around the parcel, of ``buffer`` or, for rings in degrees, of ``metres``. Parcels of
    a product that combines are asked for together when their buffered boxes share a cell as
    large as the buffer, within tiles of ``tile`` that bound what one request can hold;
    a parcel is in the tile of its box's lower left corner. Other parcels are areas of their own.
    """
    kind = registry.PRODUCTS[product]
    wide = g.buffered(F.col("ring"), F.lit(buffer)) if metres is None else g.buffered_degrees(F.col("ring"), F.lit(metres))
    ring = wide if kind.needs_scaling else F.col("ring")
    rows = sectors.select("sector_id", "ring", ring.alias("asked"))
    if not kind.combinable:
        return rows.select("sector_id", F.col("sector_id").cast("string").alias("area_id"), "ring", "asked")
    x0, y0, x1, y1 = g.bounds(F.col("ring"))
    around = _cells(x0 - buffer, y0 - buffer, x1 + buffer, y1 + buffer, buffer)
    celled = sectors.select("sector_id", F.floor(x0 / tile).alias("tx"), F.floor(y0 / tile).alias("ty"), F.explode(around).alias("cell"))
    first = celled.groupBy("tx", "ty", "cell").agg(F.min("sector_id").alias("b"))  # a link to the least parcel of each cell: no pairs
    links = celled.join(first, ["tx", "ty", "cell"]).select(F.col("sector_id").alias("a"), "b").distinct()
    roots = components(links).select(F.col("node").alias("sector_id"), F.col("root").cast("string").alias("area_id"))
    return rows.join(roots, "sector_id").select("sector_id", "area_id", "ring", "asked")


def requests(asked: DataFrame, have: DataFrame, product: str, start: str, end: str, max_days: int = 92) -> DataFrame:
    """(request_id, area_id, product, start, end, rings): runs of at most ``max_days`` days that a parcel of the area lacks.

    ``have``: (sector_id, d). A parcel's rings of an area are together in one request; areas are bounded by their tile.
    """
    lacking = dates.missing_days(have, asked.select("sector_id").distinct(), start, end)
    days = lacking.join(asked.select("sector_id", "area_id"), "sector_id").select("area_id", "d").distinct()
    runs = dates.islands(days, ["area_id"])
    every = F.sequence("start", "end", F.expr(f"interval {max_days} days"))
    runs = runs.select("area_id", "end", F.explode(every).alias("start")).select("area_id", "start", F.least("end", F.date_add("start", max_days - 1)).alias("end"))
    rings = asked.groupBy("area_id").agg(F.array_sort(F.collect_set("asked")).alias("rings"))
    of = F.sha2(F.concat_ws("|", F.lit(product), "area_id", F.to_json(F.struct("rings")), "start", "end"), 256)
    return runs.join(rings, "area_id").select(of.alias("request_id"), "area_id", F.lit(product).alias("product"), "start", "end", "rings")


# Downloads


def fetch(wanted: DataFrame, transport: str, retries: int = 1, wait: float = 5.0, **options: str) -> DataFrame:
    """What a transport ("module:Class") gives for each request: rows (request_id, kind, time, payload, error).

    kind: "file" with its payload, "empty" (a day known to have none), and one "done", or "failed"
    with the error, for each request. Requests are dealt to tasks by their id; a task holds one request's answer at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = transport.partition(":")
        line = getattr(importlib.import_module(module), name)(options)
        for batch in batches:
            for asked in batch.to_pylist():
                rings = [[(p["px"], p["py"]) for p in ring] for ring in asked["rings"]]
                ask = {"area_id": asked["area_id"], "product": asked["product"], "start": asked["start"].isoformat(), "end": asked["end"].isoformat(), "rings": rings} | options
                key = asked["request_id"]
                try:
                    got = retried(lambda ask=ask: list(line.fetch(ask)), retries, wait)
                    rows = [(key, "empty" if r.get("payload") is None else "file", r["time"], r.get("payload"), None) for r in got] + [(key, "done", None, None, None)]
                except OSError as e:
                    rows = [(key, "failed", None, None, str(e))]
                held, size = [], 0
                for row in rows:
                    held.append(row)
                    size += len(row[3] or b"")
                    if size > _BATCH_BYTES or row is rows[-1]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FETCHED, strict=True)], schema=_FETCHED)
                        held, size = [], 0

    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes of requests are much work
    return wanted.repartition(tasks, "request_id").mapInArrow(run, "request_id string, kind string, time timestamp, payload binary, error string")


# The caches


@dataclass
class Store:
    """A product's tables: cells in partitions, empty days (of all products), downloads not yet worked in, and what was asked for."""

    cube: PartitionedCache
    no_data: Cache
    staged: Cache
    ledger: Cache

    @classmethod
    def at(cls, spark: SparkSession, folder: str, product: str) -> Store:
        """The tables below a folder."""
        cells = schema.PIXEL + "".join(f", {v} double" for v in registry.PRODUCTS[product].variables)
        below = folder.rstrip("/")
        others = {"staged": schema.STAGED, "ledger": schema.LEDGER}
        return cls(PartitionedCache(spark, f"{below}/cube-{product}", cells), Cache(spark, f"{below}/no_data", schema.NO_DATA), *[Cache(spark, f"{below}/{k}-{product}", s) for k, s in others.items()])


def dealt(pixels: DataFrame, asked: DataFrame, lacking: DataFrame, values: Sequence[str], cell: float) -> DataFrame:
    """An area's cells (area_id, time, y, x) as those of its parcels that lack the day: in the parcel's box, NULL outside its ring.

    Parcels and cells of an area meet in the squares of a grid.
    """
    x0, y0, x1, y1 = g.bounds(F.col("ring"))
    boxes = asked.select("area_id", "sector_id", x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"), F.explode(_cells(x0, y0, x1, y1, cell)).alias("_cell"))
    at = F.struct(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    met = pixels.withColumn("_cell", at).join(boxes, ["area_id", "_cell"]).where("x between _x0 and _x1 and y between _y0 and _y1")
    wanted = met.withColumn("d", F.to_date("time")).join(lacking, ["sector_id", "d"], "left_semi").select(*PIXEL, *values)
    return spatial.mask_by_sector(wanted, asked.select("sector_id", "ring"), values)


def work_in(store: Store, sectors: DataFrame, product: str, today: str | None, buffer: float, tile: float, metres: float | None = None) -> DataFrame:
    """Work the staged downloads into the caches and the ledger; (request_id, time, error) of broken files. Twice gives the same as once."""
    kind, staged = registry.PRODUCTS[product], store.staged.read()
    spark = staged.sparkSession
    tables = Staged(spark, "satellite")
    asked = areas(sectors, product, buffer, tile, metres)
    kept, known = store.cube.read(), store.no_data.read()
    mine = known.where(F.col("product") == product)
    kept_days = tables.table(dates.distinct_days(kept, mine))
    answered = staged.where("kind = 'done'").select("area_id", F.explode(F.sequence("start", "end")).alias("d")).distinct()
    members = asked.select("sector_id", "area_id")
    lacking = tables.table(answered.join(members, "area_id").join(kept_days, ["sector_id", "d"], "left_anti").select("sector_id", "area_id", "d"))
    files = tiff.explode_tiffs(staged.where("kind = 'file'").select("request_id", "area_id", "time", "payload"), ["request_id", "area_id", "time"])
    cells = tables.table(files)  # decoded once, read for cells, days and faults
    broken = cells.where("_error is not null").select("request_id", "area_id", "time", F.col("_error").alias("error"))
    wide = cells.where("_error is null").groupBy("area_id", "time", "y", "x").agg(*[F.max(F.when(F.col("band") == i, F.col("value"))).alias(v) for i, v in enumerate(kind.variables)])
    daily = one_time_a_day(wide.withColumnRenamed("area_id", "sector_id"), kind.variables).withColumnRenamed("sector_id", "area_id")
    store.cube.merge(dealt(daily, asked, lacking.select("sector_id", "d"), kind.variables, max(buffer, tile / 256)))
    seen = cells.select("area_id", F.to_date("time").alias("d")).distinct()
    told = staged.where("kind = 'empty'").select("area_id", F.to_date("time").alias("d"))
    last = F.date_sub(F.current_date() if today is None else F.to_date(F.lit(today)), kind.hidden_days)
    none = lacking.select("area_id", "d").distinct().join(seen, ["area_id", "d"], "left_anti").where(F.col("d") <= last).union(told.join(seen, ["area_id", "d"], "left_anti")).distinct()
    empty = lacking.join(none, ["area_id", "d"]).select("sector_id", F.lit(product).alias("product"), "d")
    store.no_data.write(sync.record_no_data(known, empty))
    faults = broken.groupBy("request_id").agg(F.count(F.lit(1)).alias("broken"))
    outcome = staged.where("kind in ('done', 'failed')").select("request_id", "area_id", "product", "start", "end", "attempt", F.col("kind").alias("state"), "error")
    counts = staged.where("kind = 'file'").groupBy("request_id").agg(F.count(F.lit(1)).alias("files"))
    zero = F.lit(0).cast("long")
    more = outcome.join(counts, "request_id", "left").join(faults, "request_id", "left").withColumns({"files": F.coalesce("files", zero), "broken": F.coalesce("broken", zero)})
    ledger = store.ledger.read()
    store.ledger.write(ledger.join(more.select("request_id", "attempt"), ["request_id", "attempt"], "left_anti").unionByName(more))
    quarantine = tables.table(broken.select("request_id", "area_id", "time", "error"))
    store.staged.write(staged.limit(0))
    tables.drop(keep=1)
    return quarantine


def update(
    store: Store, sectors: DataFrame, product: str, start: str, end: str, transport: str, *, today: str | None = None, buffer: float = 0.001, tile: float = 0.25, metres: float | None = None,
    max_days: int = 92, max_attempts: int = 3, **options,
) -> dict[str, DataFrame]:
    """The product's caches after the days that parcels (sector_id, ring, in the cube's coordinates) lack in a range were acquired.

    Each gap is downloaded once: runs of days a parcel or, for a product that combines, an
    area lacks. Files of one day become one at the middle of its instants. Cells outside a parcel's
    ring are NULL. Days without a file are known to be empty from then on, up to the provider's delay before
    ``today`` (a day later may still get one), but those whose file is broken, which stay gaps
    and are returned as ``quarantine``. A request that fails stays a gap, asked for again
    in later runs up to ``max_attempts`` times. Downloads of a run that was lost are worked in first. Returned: cube, no_data, ledger, quarantine.
    """
    quarantine = work_in(store, sectors, product, today, buffer, tile, metres) if not store.staged.read().isEmpty() else None
    kept, known = store.cube.read(), store.no_data.read()
    have = dates.distinct_days(kept, known.where(F.col("product") == product))
    tried = store.ledger.read().groupBy("request_id").agg(F.max("attempt").alias("_tried"), F.max_by("state", "attempt").alias("_state"))
    wanted = requests(areas(sectors, product, buffer, tile, metres), have, product, start, end, max_days).join(tried, "request_id", "left")
    wanted = wanted.where(F.col("_tried").isNull() | (F.col("_tried") < max_attempts) | (F.col("_state") == "done"))
    tables = Staged(wanted.sparkSession, "requests")
    wanted = tables.table(wanted.withColumn("attempt", F.coalesce("_tried", F.lit(0)) + 1).drop("_tried", "_state"))
    got = fetch(wanted.drop("attempt"), transport, **options).join(wanted.drop("rings"), "request_id")
    store.staged.write(got)
    later = work_in(store, sectors, product, today, buffer, tile, metres)
    tables.drop()
    return {"cube": store.cube.read(), "no_data": store.no_data.read(), "ledger": store.ledger.read(), "quarantine": later if quarantine is None else quarantine.unionByName(later)}
