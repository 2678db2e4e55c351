"""Cubes, rasters and images against polygons and points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcube.functions import geometry as g
from fieldcube.functions import overlay as ov
from fieldcube.operators import frames


def within_box(cube: DataFrame, ring: Sequence[g.Point]) -> DataFrame:
    """Pixels in a ring's bounding box; plain comparisons, so that they reach the scan."""
    xs, ys = [float(p[0]) for p in ring], [float(p[1]) for p in ring]
    return cube.where((F.col("x") >= min(xs)) & (F.col("x") <= max(xs)) & (F.col("y") >= min(ys)) & (F.col("y") <= max(ys)))


def mask(cube: DataFrame, ring: Sequence[g.Point], values: Sequence[str], box: bool = True, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Values outside a ring as NULL, the table's shape kept; ``box`` keeps only the bounding box first.

    The test point is the stored coordinate plus (dx, dy): half a step for grids
    that store a corner, as a raster mask tests centres.
    """
    rows = within_box(cube, ring) if box else cube
    inside = g.in_ring(F.col("x") + dx, F.col("y") + dy, ring)
    return rows.withColumns({v: F.when(inside, F.col(v)) for v in values})


def mask_by_sector(cube: DataFrame, sectors: DataFrame, values: Sequence[str]) -> DataFrame:
    """``mask`` for every sector's own ring; sectors: (sector_id, ring)."""
    x0, y0, x1, y1 = g.bounds(F.col("ring"))
    boxed = sectors.select("sector_id", "ring", x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"))
    rows = cube.join(boxed, "sector_id").where("x between _x0 and _x1 and y between _y0 and _y1")
    inside = g.in_ring(F.col("x"), F.col("y"), F.col("ring"))
    return rows.withColumns({v: F.when(inside, F.col(v)) for v in values}).select(*cube.columns)


def point_sample(cube: DataFrame, x: float, y: float, values: Sequence[str], compat: bool = False) -> DataFrame:
    """(sector_id, time, values, means): the pixel that holds a point, and the mean over the grid.

    The column is the largest x up to the point's, the row the smallest y from the
    point's up; outside, the nearest ones (``compat``: the southernmost row if the
    point lies north). Both come from one aggregate a sector.
    """
    grid = cube.groupBy("sector_id").agg(
        F.coalesce(F.max(F.when(F.col("x") <= x, F.col("x"))), F.min("x")).alias("_x"),
        F.coalesce(F.min(F.when(F.col("y") >= y, F.col("y"))), F.min("y") if compat else F.max("y")).alias("_y"),
    )
    here = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    at = cube.join(grid, "sector_id")
    picked = [F.max(F.when(here, F.col(v))).alias(v) for v in values]
    return at.groupBy("sector_id", "time").agg(*picked, *[F.avg(v).alias(f"{v}_mean") for v in values], F.max(here).alias("_met")).where("_met").drop("_met")


def _meeting(a: DataFrame, b: DataFrame, points_a: Column, points_b: Column, cell: float) -> DataFrame:
    """Rows of both tables whose points' boxes have a point in common, each pair once, spread over all tasks; with the boxes, as _ax0 to _by1.

    A box is in the cells of the finest grid whose cells are as large as it: the sides of the cells are ``cell`` times powers of two, so that
    it touches few of them whatever its size. Two boxes meet in the grid of the larger one, in the first cell that both touch.
    """

    def sized(df: DataFrame, name: str, points: Column) -> DataFrame:
        box = dict(zip((f"_{name}{k}" for k in ("x0", "y0", "x1", "y1")), g.bounds(points), strict=True))
        rows = df.withColumns(box).where(F.col(f"_{name}x0").isNotNull() & F.col(f"_{name}y0").isNotNull())
        side = F.greatest(F.col(f"_{name}x1") - F.col(f"_{name}x0"), F.col(f"_{name}y1") - F.col(f"_{name}y0"))
        return rows.withColumn(f"_{name}l", F.when(side > cell, F.least(F.lit(60), F.ceil(F.log2(side / cell)))).otherwise(0).cast("int"))

    def celled(rows: DataFrame, others: DataFrame, name: str, other: str) -> DataFrame:
        levels = others.agg(F.collect_set(f"_{other}l").alias("_levels"))  # 61 at most
        own = F.col(f"_{name}l")
        rows = rows.crossJoin(F.broadcast(levels)).withColumn("_l", F.explode(F.concat(F.array(own), F.filter("_levels", lambda x: x > own)))).drop("_levels")
        steps = lambda k: F.explode(F.sequence(F.floor(F.col(f"_{name}{k}0") / size), F.floor(F.col(f"_{name}{k}1") / size)))
        return rows.withColumn("_cx", steps("x")).withColumn("_cy", steps("y"))

    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_l"))
    left, right = sized(a, "a", points_a), sized(b, "b", points_b)
    met = celled(left, right, "a", "b").join(celled(right, left, "b", "a"), ["_l", "_cx", "_cy"])
    first = (F.col("_cx") == F.floor(F.greatest("_ax0", "_bx0") / size)) & (F.col("_cy") == F.floor(F.greatest("_ay0", "_by0") / size))
    boxes = [[F.col(f"_{name}{k}") for k in ("x0", "y0", "x1", "y1")] for name in "ab"]
    met = met.where((F.col("_l") == F.greatest("_al", "_bl")) & first & g.boxes_overlap(*boxes)).drop("_l", "_cx", "_cy", "_al", "_bl")
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[c for c, kind in met.dtypes if not kind.startswith("array")])


def intersecting(polygons: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Pairs (id, area_id) of polygons with a point in common, each once; both: (…id, ring).

    Equal rings are one shape: shapes meet in grids of cells from ``cell`` up (see :func:`_meeting`), are tested
    once a pair, and the pairs of ids follow from those of shapes. Only ids with several shapes need their pairs made distinct.
    """

    def shaped(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(F.col(key), F.sha2(F.to_json(F.struct("ring")), 256).alias(f"_{name}"), "ring").where("ring is not null")
        ids = rows.select(key, f"_{name}").distinct().withColumn(f"_{name}_more", F.count(F.lit(1)).over(W.partitionBy(key)) > 1)
        return frames.blocks(ids, [f"_{name}", f"_{name}_more"], f"_{name}_ids"), rows.groupBy(f"_{name}").agg(F.any_value("ring").alias(f"_{name}_ring"))

    (ids_a, rings_a), (ids_b, rings_b) = shaped(polygons, "id", "a"), shaped(areas, "area_id", "b")
    a, b = F.col("_a_ring"), F.col("_b_ring")
    shapes = _meeting(rings_a, rings_b, a, b, cell).where(g.rings_intersect(a, b)).select("_a", "_b")
    met = shapes.join(ids_a, "_a").join(ids_b, "_b")
    pairs = lambda rows: frames.paired(rows, ["_a", "_b"], "_a_ids", "_b_ids").select("_a_ids.id", "_b_ids.area_id")
    more = F.col("_a_more") | F.col("_b_more")
    return pairs(met.where(~more)).unionAll(pairs(met.where(more)).distinct())


_RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("px", T.DoubleType()), T.StructField("py", T.DoubleType())])))


def _plain(polygons: pa.Array) -> list[list[list[g.Point]]]:
    """Polygons as lists of rings of (x, y)."""

    def cut(items: list, lists: pa.Array) -> list[list]:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
        return [items[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    rings = polygons.flatten()
    points = rings.flatten()
    return cut(cut(list(zip(*[pc.struct_field(points, k).to_pylist() for k in ("px", "py")], strict=True)), rings), polygons)


def _nested(lists: list[list], inner: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), inner)


@F.arrow_udf(T.StructType([T.StructField("area", T.DoubleType()), T.StructField("parts", _RINGS)]))
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    found = [ov.common(x, y) for x, y in zip(_plain(a), _plain(b), strict=True)]
    parts = [rings for _, rings in found]
    rings = [ring for of in parts for ring in of]
    points = [pa.array([p[k] for ring in rings for p in ring], pa.float64()) for k in (0, 1)]
    nested = _nested(parts, _nested(rings, pa.StructArray.from_arrays(points, ["px", "py"])))
    return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.float64()), nested], ["area", "parts"])


def overlay(polygons: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(id, area_id, area, parts) of pairs of polygons that have an area in common; both: (…id, rings), under the even-odd rule.

    Polygons meet by their boxes in grids of cells from ``cell`` up (see :func:`_meeting`), each pair once; the
    pairs are spread over all tasks before they are worked out. Polygons without points meet nothing.
    """
    a, b = polygons.select("id", F.col("rings").alias("_a")), areas.select("area_id", F.col("rings").alias("_b"))
    met = _meeting(a, b, F.flatten("_a"), F.flatten("_b"), cell)
    boxes = (F.col("_ax0") < F.col("_bx1")) & (F.col("_bx0") < F.col("_ax1")) & (F.col("_ay0") < F.col("_by1")) & (F.col("_by0") < F.col("_ay1"))
    return met.where(boxes).select("id", "area_id", _common("_a", "_b").alias("_c")).select("id", "area_id", "_c.*").where("area > 0")


def image_alpha(pixels: DataFrame, ring: Sequence[g.Point], width: int, height: int) -> DataFrame:
    """Image pixels with alpha 255 inside a ring and 0 outside; the ring's box is the image, north up."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    place = lambda p: (float((p[0] - min(xs)) * width // (max(xs) - min(xs))), float((max(ys) - p[1]) * height // (max(ys) - min(ys))))
    inside = g.in_ring(F.col("col").cast("double"), F.col("row").cast("double"), [place(p) for p in ring])
    return pixels.withColumn("a", F.when(inside, 255).otherwise(0))
