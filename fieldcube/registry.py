"""Products, biome parameters and the crops' biomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldcube.schema import BANDS


@dataclass(frozen=True)
class Product:
    """A remote product: what to ask for, and how its cells are cached."""

    model_name: str
    variables: tuple[str, ...]
    combinable: bool
    needs_scaling: bool
    biopar_type: str | None = None
    geometry: str = "polygon"
    hidden_days: int = 0


# Request name of a vegetation product and its provider type.
BIOPAR = {"fapar": "fAPAR", "nitrogen": "CCC", "canopy_water": "CWC", "vegetation_cover": "fCOVER", "leaf_area": "LAI"}

PRODUCTS = {"bands": Product("SENTINEL2_L2A", tuple(BANDS), combinable=True, needs_scaling=False)} | {
    name: Product("BIOPAR", (name,), combinable=False, needs_scaling=True, biopar_type=kind) for name, kind in BIOPAR.items()
}

# The published MOD17 biome parameters.
BPLUT_COLUMNS = [
    "lue_max", "tmin_min", "tmin_max", "vpd_min", "vpd_max", "sla", "q10", "froot_leaf_ratio", "livewood_leaf_ratio", "leaf_mr_base", "froot_mr_base", "livewood_mr_base",
]
BPLUT = {
    "ENF": (0.000962, -8.0, 8.31, 650.0, 4600.0, 14.1, 2.0, 1.2, 0.182, 0.00604, 0.00519, 0.00397),
    "EBF": (0.001268, -8.0, 9.09, 800.0, 3100.0, 25.9, 2.0, 1.1, 0.162, 0.00604, 0.00519, 0.00397),
    "DNF": (0.001086, -8.0, 10.44, 650.0, 2300.0, 15.5, 2.0, 1.7, 0.165, 0.00815, 0.00519, 0.00397),
    "DBF": (0.001165, -6.0, 9.94, 650.0, 1650.0, 21.8, 2.0, 1.1, 0.203, 0.00778, 0.00519, 0.00371),
    "MF": (0.001051, -7.0, 9.5, 650.0, 2400.0, 21.5, 2.0, 1.1, 0.203, 0.00778, 0.00519, 0.00371),
    "CShrub": (0.001281, -8.0, 8.61, 650.0, 4700.0, 9.0, 2.0, 1.0, 0.079, 0.00869, 0.00519, 0.00436),
    "OShrub": (0.000841, -8.0, 8.8, 650.0, 4800.0, 11.5, 2.0, 1.3, 0.04, 0.00519, 0.00519, 0.00218),
    "WSavanna": (0.001239, -8.0, 11.39, 650.0, 3200.0, 27.4, 2.0, 1.8, 0.091, 0.00869, 0.00519, 0.00312),
    "Savanna": (0.001206, -8.0, 11.39, 650.0, 3100.0, 27.1, 2.0, 1.8, 0.051, 0.00869, 0.00519, 0.001),
    "Grass": (0.00086, -8.0, 12.02, 650.0, 5300.0, 37.5, 2.0, 2.6, 0.0, 0.0098, 0.00819, 0.0),
    "Crop": (0.001044, -8.0, 12.02, 650.0, 4300.0, 30.4, 2.0, 2.0, 0.0, 0.0098, 0.00819, 0.0),
}
# The biomes of crop names, and the least days of a crop; own to the described service.
CROP_BIOME = {"missing_data": "Grass", "Grass": "Grass", "Crop": "Crop", "weizen": "Crop", "kartoffeln": "Crop", "grassland": "Grass"}
DEFAULT_CROP = CROP_BIOME["missing_data"]
MIN_CROP_DAYS = 30


def bplut(spark: SparkSession) -> DataFrame:
    """(biome, parameters…): a fixed table of 11 rows."""
    return spark.createDataFrame([(k, *v) for k, v in BPLUT.items()], "biome string" + "".join(f", {c} double" for c in BPLUT_COLUMNS))


def crop_biome(spark: SparkSession) -> DataFrame:
    """(crop_name, biome): a fixed table."""
    return spark.createDataFrame([*CROP_BIOME.items()], "crop_name string, biome string")
