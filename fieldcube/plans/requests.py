"""Requests: what a client asks for, and the tables that answer it."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube import registry, schema
from fieldcube.functions import geometry, indices, projections
from fieldcube.operators import cube, dates, growth, spatial
from fieldcube.plans import background, gpp
from fieldcube.sources import tables as tables_
from fieldcube.sources import tiff

DEFAULT_FARM = "generic_farm"


class RequestError(ValueError):
    """A request that can't be answered as it is."""


@dataclass(frozen=True)
class Request:
    """A checked request."""

    ring: list[geometry.Point]
    farm_id: str
    sector_id: str
    start: str
    end: str
    products: Mapping[str, list[str]] = field(default_factory=dict)
    composites: Mapping[str, list[str]] = field(default_factory=dict)
    weather: Mapping[str, list[str]] = field(default_factory=dict)
    gpp_modes: list[str] = field(default_factory=list)
    interpolation: str | None = None
    image_size: int = 0
    crops: list[dict] = field(default_factory=list)
    crs: int | None = None


def parse(body: Mapping, taken: int = 0, today: str | None = None) -> Request:
    """Check a request body; raises RequestError. ``taken``: sectors that exist, for the number of an unnamed one."""
    shape = body.get("geometry") or {}
    rings = shape.get("coordinates") or []
    if shape.get("type") != "Polygon" or not rings or len(rings[0]) < 4 or rings[0][0] != rings[0][-1]:
        raise RequestError("geometry is a Polygon with a closed ring")
    if any(len(p) < 2 or not all(isinstance(c, (int, float)) and math.isfinite(c) for c in p[:2]) for p in rings[0]):
        raise RequestError("a ring's points are pairs of numbers")
    data, asked = body.get("input_data") or {}, body.get("requests") or {}
    ids, remote = data.get("id") or {}, asked.get("copernicus_data") or {}
    try:
        start, end = dates.check_range(asked.get("date_range"), today)
    except ValueError as e:
        raise RequestError(str(e)) from e
    photosynthesis = asked.get("photosynthesis") or {}
    return Request(
        ring=[(float(p[0]), float(p[1])) for p in rings[0]],
        farm_id=ids.get("farm_id") or DEFAULT_FARM,
        sector_id=ids.get("sector_id") or f"Parzelle_{taken}",
        start=start,
        end=end,
        products={p: list(remote[p]) for p in registry.PRODUCTS if remote.get(p)},
        composites={c: list(m) for c, m in (remote.get("composites") or {}).items() if m},
        weather={k: list(v) for k, v in (asked.get("weather_data") or {}).items() if v},
        gpp_modes=list(photosynthesis.get("mean") or []),
        interpolation=photosynthesis.get("interpolation"),
        image_size=(asked.get("satellite_image") or {}).get("max_size") or 0,
        crops=[c | {"seq": i} for i, c in enumerate(data.get("crop_data") or [])],
        crs=_epsg(shape.get("crs")),
    )


def _epsg(crs: Mapping | None) -> int | None:
    """The EPSG number of a GeoJSON crs member; its name ends with it."""
    name = str(((crs or {}).get("properties") or {}).get("name") or "")
    number = name.rpartition(":")[2]
    if name and not number.isdigit():
        raise RequestError(f"unknown coordinate system {name}")
    return int(number) if number else None


def needed_products(request: Request) -> set[str]:
    """The products that must be there: asked ones, the bands of composites, fAPAR for GPP."""
    return {*request.products, *({"bands"} if request.composites else ()), *({"fapar"} if request.gpp_modes else ())}


def ring_for(request: Request, tables: Mapping[str, DataFrame], product: str) -> list[geometry.Point]:
    """The request's ring in the coordinates of a product's cube, by ``cube_meta`` (one row a sector and product); as it is without such a row."""
    if "cube_meta" not in tables:
        return request.ring
    row = tables["cube_meta"].where((F.col("sector_id") == request.sector_id) & (F.col("product") == product)).select("crs").first()
    if row is None:
        return request.ring
    try:
        return projections.ring_in(request.ring, row["crs"], request.crs)
    except ValueError as e:
        raise RequestError(str(e)) from e


def answer(request: Request, tables: Mapping[str, DataFrame], *, mask: bool = True) -> dict[str, DataFrame]:
    """Tables by product and mode, e.g. ``ndvi.spatial_mean``; all of them lazy.

    ``tables`` holds the caches: a cube per product, ``weather_hourly`` and
    ``weather_daily``, ``par``, and if there are any ``cube_meta``, ``background`` and
    ``image``. A product that wasn't asked for isn't in the answer. Composites and growth are read
    from the caches ``composites`` and ``growth`` where these have them (see :mod:`derived`); else growth is found on
    the whole cached cube, as its windows reach beyond the asked days, and then cut to them.
    Without ``background``, it is made from ``soil_geo`` (area_id, ring, …), ``soil_info``, ``soil_legend`` and ``bg_raster``.
    """
    cached = {c for t in ("composites", "growth") if t in tables for c in tables[t].columns}
    bare = needed_products(request) - ({"bands"} if "bands" not in request.products and {*request.composites} <= cached else set())
    lacking = bare - tables.keys()
    if lacking:
        raise RequestError(f"no data for {', '.join(sorted(lacking))}")

    def within(rows: DataFrame, time: str = "time") -> DataFrame:
        return cube.time_slice(rows, request.start, request.end, time)

    def whole(name: str, product: str | None = None) -> DataFrame:
        rows = tables[name].where(F.col("sector_id") == request.sector_id)
        return spatial.mask(rows, ring_for(request, tables, product or name), cube.values_of(rows)) if mask else rows

    def of(name: str) -> DataFrame:
        return within(whole(name))

    def composite(name: str) -> DataFrame:
        if name in cached:
            return within(whole("growth" if name == "ags" else "composites", "bands").select(*cube.KEYS, name))
        if name == "ags":
            return within(growth.rolling_growth(indices.composites(whole("bands"), ["ndvi"])))
        return made.select(*cube.KEYS, name)

    out: dict[str, DataFrame] = {}
    for name, modes in request.products.items():
        out |= {f"{name}.{m}": df for m, df in cube.summaries(of(name), modes).items()}
    unknown = sorted(request.composites.keys() - indices.RULES.keys() - {"ags"})
    if unknown:
        raise RequestError(f"unknown composite {unknown[0]}")
    plain = sorted(request.composites.keys() - cached - {"ags"})
    made = indices.composites(of("bands"), plain) if plain else None
    for name, modes in request.composites.items():
        out |= {f"{name}.{m}": df for m, df in cube.summaries(composite(name), modes).items()}
    if request.gpp_modes:
        spark = tables["fapar"].sparkSession
        rows = [(request.sector_id, c["seq"], c.get("crop_name"), c.get("plant_time"), c.get("harvest_time")) for c in request.crops]
        calendar = spark.createDataFrame(rows, "sector_id string, seq int, crop_name string, plant_time string, harvest_time string")
        made = gpp.gpp(of("fapar"), tables["par"], calendar, registry.crop_biome(spark), registry.bplut(spark), interpolation=request.interpolation)
        out |= {f"gpp.{m}": df for m, df in cube.summaries(made, request.gpp_modes).items()}
    for kind, variables in request.weather.items():
        rows = tables[f"weather_{kind}"].where(F.col("sector_id") == request.sector_id)
        out[f"weather.{kind}"] = within(rows, "date").select("sector_id", "date", *sorted(variables))
    if "background" not in tables and {"soil_geo", "soil_info", "soil_legend", "bg_raster"} <= tables.keys():
        out["background"] = _background(request, tables)
    for name in {"background", *(["image"] if request.image_size else [])} & tables.keys():
        out[name] = tables[name].where(F.col("sector_id") == request.sector_id)
    return out


def _background(request: Request, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The sector's soil attributes, a row for each soil polygon it meets, with the means of its rasters in the ring."""
    rasters = tables["bg_raster"].where(F.col("sector_id") == request.sector_id)
    layers = sorted(r["layer"] for r in rasters.select("layer").distinct().collect())  # a handful
    ring = ring_for(request, tables, "background")
    sector = rasters.sparkSession.createDataFrame([(request.sector_id, ring)], "sector_id string, ring array<struct<px: double, py: double>>")
    return background.background(sector, (tables["soil_geo"], tables["soil_info"], tables["soil_legend"]), rasters, layers, ring=ring)


def run_request(spark: SparkSession, body: Mapping, tables: Mapping[str, DataFrame], **options) -> dict[str, DataFrame]:
    """Parse and answer a request."""
    return answer(parse(body, **{k: options.pop(k) for k in ("taken", "today") if k in options}), tables, **options)


def save(answers: Mapping[str, DataFrame], folder: str, save_format: str = "parquet", crs: int | None = None) -> dict[str, str]:
    """Write an answer's tables below a folder, each one's place by its name: ``…full`` as a GeoTIFF a time, the others as parquet or csv."""
    out = {}
    for name, df in answers.items():
        out[name] = f"{folder.rstrip('/')}/{name}"
        value = name.partition(".")[0]
        if name.endswith(".full") and {"y", "x", value} <= {*df.columns}:
            tiff.write_tiffs(df, value, out[name], crs, deflate=True).write.format("noop").mode("overwrite").save()
        else:
            tables_.save(df, out[name], save_format)
    return out


def parse_many(bodies: DataFrame, column: str = "body", taken: int = 0) -> DataFrame:
    """Request bodies in a text column as typed columns: one pass over many requests.

    ``error`` says what :func:`parse` would refuse a body for, NULL if nothing. An
    unnamed sector gets the number of its farm's unnamed ones before it, in order of the body, after the ``taken`` ones that exist.
    """
    parsed = bodies.select("*", F.from_json(column, schema.REQUEST).alias("_r"))
    points = F.col("_r.geometry.coordinates")[0]
    ring = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("px"), F.get(p, F.lit(1)).alias("py")))
    closed = (F.col("_r.geometry.type") == "Polygon") & (F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1))
    paired = ~F.exists(ring, lambda p: p["px"].isNull() | p["py"].isNull())
    days = F.col("_r.requests.date_range")
    start, end = (F.get(days, F.lit(k)).try_cast("date") for k in (0, 1))
    ranged = days.isNull() | (F.size(days) == 0) | (F.size(days) == 2) & (start <= end)
    error = F.when(~F.coalesce(closed, F.lit(False)), "geometry is a Polygon with a closed ring").when(~paired, "a ring's points are pairs of numbers").when(~F.coalesce(ranged, F.lit(False)), "a date range has a start and an end, in order")
    farm, sector = F.coalesce("_r.input_data.id.farm_id", F.lit(DEFAULT_FARM)), F.col("_r.input_data.id.sector_id")
    unnamed = F.row_number().over(W.partitionBy("farm_id", F.col("_s").isNull()).orderBy(column)) - 1 + taken
    rows = parsed.select(
        *bodies.columns, farm.alias("farm_id"), sector.alias("_s"), ring.alias("ring"), start.alias("start"), end.alias("end"), F.col("_r.requests").alias("requests"), F.col("_r.input_data.crop_data").alias("crops"), error.alias("error"),
    )
    return rows.select(*bodies.columns, "farm_id", F.coalesce("_s", F.concat(F.lit("Parzelle_"), unnamed.cast("string"))).alias("sector_id"), "ring", "start", "end", "requests", "crops", "error")
