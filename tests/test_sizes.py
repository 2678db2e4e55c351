"""Steps whose work must follow the input's size, not the number of equal keys or the size of shapes."""

import math
import random
import re

from pyspark.sql import functions as F

from fieldcube import fixtures, queries
from fieldcube.operators import frames, spatial
from fieldcube.plans import satellite
from fieldcube.sources import tiff


def _box(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


RING = "ring array<struct<px: double, py: double>>"


def test_large_and_small_rings_meet_on_few_cells(spark):
    """A ring of 10^13 of the smallest cells, which couldn't be listed."""
    a = spark.createDataFrame([(1, _box(0.0, 0.0, 30000.0)), (2, _box(-5.0, -5.0, 1.0))], f"id long, {RING}")
    b = spark.createDataFrame([(1, _box(29999.0, 17.0, 0.005)), (2, _box(-4.5, -4.5, 0.004)), (3, _box(-9.0, 3.0, 8.9)), (4, _box(-9.0, 3.0, 9.0))], f"area_id long, {RING}")
    assert sorted(map(tuple, spatial.intersecting(a, b, 0.01).collect())) == [(1, 1), (1, 4), (2, 2)]


def test_equal_rings_are_one_shape(spark):
    """Each pair of ids comes once, also of ids with several rings and of rows that are there twice; the pairs of one shape spread."""
    a = spark.range(2500).select("id", F.lit(None).cast("int").alias("n")).crossJoin(spark.createDataFrame([(_box(0.1, 0.1, 1.5),)], RING)).drop("n")
    b = a.withColumnRenamed("id", "area_id").where("area_id < 2000")
    met = spatial.intersecting(a.union(a.limit(3)), b, 2.0)
    assert met.count() == 2500 * 2000 == met.distinct().count()
    assert met.select(F.spark_partition_id()).distinct().count() > 1
    parts = spark.createDataFrame([(7, _box(0.0, 0.0, 1.0)), (7, _box(1.0, 0.0, 1.0)), (None, _box(0.5, 0.5, 1.0))], f"id long, {RING}")
    twice = spatial.intersecting(parts, spark.createDataFrame([(1, _box(0.9, 0.9, 0.2))], f"area_id long, {RING}"), 1.0)
    assert sorted(map(tuple, twice.collect()), key=str) == [(7, 1), (None, 1)]


def test_rows_of_one_key_spread(spark):
    """A key with many rows on both sides: their pairs are made in more than one task, equal rows as often as they are there."""
    a = spark.range(3000).select(F.lit(5).alias("k"), (F.col("id") % 1000).alias("a")).coalesce(1)
    b = spark.range(1500).select(F.lit(5).alias("k"), F.lit("same").alias("b")).coalesce(1)
    got = frames.merge(a, b)
    assert got.columns == ["k", "a", "b"] and got.count() == 3000 * 1500
    assert got.groupBy("a").count().select("count").distinct().collect()[0][0] == 4500
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert frames.merge(a, spark.createDataFrame([(None, "x"), (6, "y")], "k int, b string")).count() == 0


def test_pairs_arent_held_by_block(spark):
    """The loops over two blocks aren't compiled into one, which would hold the rows of all their pairs before it gives out the first."""
    a, b = spark.range(30).selectExpr("id % 2 as k", "string(id) as a", "id as more"), spark.range(20).selectExpr("id % 3 as k", "string(id) as b")
    got = frames.merge(a, b)
    assert sorted(map(tuple, got.collect())) == sorted((i % 2, str(i), i, str(j)) for i in range(30) for j in range(20) if i % 2 == j % 3)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    outer, inner = re.findall(r"([*]\(\d+\) )?Generate ", plan)[1::-1]
    assert inner and outer != inner


def test_raster_files_of_far_days_and_copies(spark):
    """Files in memory and back for times that nanoseconds don't reach, and cells that are there twice."""
    rows = spark.sql("select 's' as sector_id, timestamp'2400-05-01 00:00:00' as time, cast(id div 2 as double) as y, cast(id % 2 as double) as x, if(id = 3, null, id / 4) as v from range(6)")
    back = lambda df: tiff.explode_tiffs(tiff.in_memory(df, "v"), ["sector_id", "time"]).selectExpr("sector_id", "string(time)", "y", "x", "value")
    want = sorted(map(tuple, rows.selectExpr("sector_id", "string(time)", "y", "x", "v").collect()), key=str)
    assert sorted(map(tuple, back(rows).collect()), key=str) == want
    assert sorted(map(tuple, back(rows.union(rows)).collect()), key=str) == sorted(want * 2, key=str)


def test_files_of_far_days_have_names(spark, tmp_path):
    rows = spark.sql("select 's' as sector_id, timestamp'2400-05-01 06:00:00.5' as time, 1D as y, 2D as x, 0.5D as v")
    (path,) = [r.path for r in tiff.write_tiffs(rows, "v", f"file://{tmp_path}/out").collect()]
    assert path.endswith("/s/v_2400-05-01T06-00-00.500000.tiff")


def test_requests_are_dealt_to_all_tasks(spark):
    """Few bytes of requests are much work: they aren't put together to one task."""
    ring = "array(" + ", ".join(f"named_struct('px', {x}D, 'py', {y}D)" for x, y in ((0, 0), (2, 0), (2, 2), (0, 0))) + ")"
    wanted = spark.range(40).selectExpr("string(id) as request_id", "string(id) as area_id", "'leaf_area' as product", "date'2024-01-01' as start", "date'2024-01-02' as end", f"array({ring}) as rings")
    got = satellite.fetch(wanted, "fieldcube.fixtures:Archive", wait=0.0)
    assert got.where("kind = 'done'").count() == 40
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_means_dont_follow_the_order_of_rows(spark, tmp_path):
    """A cell of 32 rows whose mean, 0.0303125, lies halfway between two rounded values."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 10) / 100, rng.randint(0, 8) / 100) for _ in range(32)]
    for n, some in enumerate((rows, rows[::-1], sorted(rows))):
        df = spark.createDataFrame(some, "l_discount double, l_tax double").selectExpr("*", "5L as l_suppkey", "1 as l_linenumber", "10D as l_quantity", "100D as l_extendedprice", "timestamp'1996-01-01 00:00:00' as l_shipdate")
        df.coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        (row,) = queries.QUERIES["cube_concat"](spark, f"{tmp_path}/{n}").collect()
        assert (row.v, row.w) == (0.030313, None)


def test_exact_mean_of_odd_numbers(spark):
    """As one correctly rounded sum; finer, large and missing numbers count as in a plain mean."""
    mean = lambda *values: spark.createDataFrame([(v,) for v in values], "a double").agg(fixtures.exact_mean(F.col("a"))).first()[0]
    assert mean(0.1, 0.2) == (0.1 + 0.2) / 2 and mean(None, 0.3) == 0.3 and mean(None) is None
    rng = random.Random(1)
    some = [rng.choice((rng.randint(0, 10) / 100, rng.randint(90000, 9999999) / 100, rng.uniform(-9e4, 9e4))) for _ in range(500)]
    assert mean(*some) == mean(*some[::-1]) == math.fsum(some) / 500
    assert mean(1e300, -2.5) == 5e299 and mean(2.0**60, 0.5) == 2.0**59
    assert mean(1e-300, 3e-300) == 2e-300 and math.isclose(mean(1e-9, -3e-9), -1e-9)
    assert math.isnan(mean(math.nan, 1.0)) and mean(-math.inf, 1.0) == -math.inf
