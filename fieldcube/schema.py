"""Schemas of the domain tables. Missing values are NULL, times are UTC, values are DOUBLE."""

from __future__ import annotations

BANDS = ["b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12", "scl", "aot", "wvp"]

PIXEL = "sector_id string, time timestamp, y double, x double"
CUBE = f"{PIXEL}, value double"
BAND_CUBE = PIXEL + "".join(f", {b} double" for b in BANDS)
CUBE_META = "sector_id string, product string, crs int"
NO_DATA = "sector_id string, product string, d date"
SECTORS = "farm_id string, sector_id string, ring array<struct<px: double, py: double>>, crs int"
WEATHER = "sector_id string, date timestamp, variable string, value double"
PAR = "sector_id string, date date, par double"
CROP_CALENDAR = "sector_id string, seq int, crop_name string, plant_time date, harvest_time date"
BG_RASTER = "sector_id string, layer string, y double, x double, value double"
IMAGE = "sector_id string, row int, col int, r int, g int, b int, a int"
STAGED = "request_id string, area_id string, product string, start date, end date, attempt int, kind string, time timestamp, payload binary, error string"
LEDGER = "request_id string, area_id string, product string, start date, end date, attempt int, state string, error string, files long, broken long"
ACQUISITION = "sector_id string, product string, time timestamp, payload binary"

_MODES = "array<string>"
_COMPOSITES = ["ndvi", "savi", "evi", "evi2", "gndvi", "msi", "ndmi", "nbr", "psri", "ari", "arvi", "sipi", "ndyi", "ags"]
REQUEST = (
    "geometry struct<type: string, coordinates: array<array<array<double>>>>, "
    "input_data struct<id: struct<farm_id: string, sector_id: string>, crop_data: array<struct<crop_name: string, plant_time: string, harvest_time: string>>>, "
    "requests struct<date_range: array<string>, satellite_image: struct<max_size: int>, weather_data: struct<daily: array<string>, hourly: array<string>>, "
    f"copernicus_data: struct<{', '.join(f'{p}: {_MODES}' for p in ('fapar', 'nitrogen', 'canopy_water', 'vegetation_cover', 'leaf_area', 'bands'))}, "
    f"composites: struct<{', '.join(f'{c}: {_MODES}' for c in _COMPOSITES)}>>, "
    "photosynthesis: struct<interpolation: string, mean: array<string>>>, "
    "options struct<cache: boolean>"
)
