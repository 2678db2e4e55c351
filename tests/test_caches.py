"""Caches in partitions: what a merge rewrites, writers beside each other, clean-up."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from fieldcube import schema
from fieldcube.sources import partitioned, tables
from fieldcube.sources.commits import Conflict
from fieldcube.streaming import upserts

CUBE = schema.CUBE


def at(d):
    return dt.datetime(2019, 1, 1, 10) + dt.timedelta(d)


def rows(spark, values):
    """(sector, day, value) as cells."""
    return spark.createDataFrame([(s, at(d), 0.0, 0.0, float(v)) for s, d, v in values], CUBE)


def held(df):
    return sorted((r.sector_id, (r.time - at(0)).days, r.value) for r in df.collect())


@pytest.fixture
def cache(spark, tmp_path):
    return partitioned.PartitionedCache(spark, f"file://{tmp_path}/cube", CUBE, buckets=4)


def test_merge_rewrites_what_it_touches(spark, cache):
    first = [(s, d, 1) for s in "abcdefgh" for d in range(0, 100, 10)]
    done = cache.merge(rows(spark, first))
    assert done.commit == 1 and len(done.partitions) == len(cache.partitions()) > 8
    assert held(cache.read()) == sorted((s, d, float(v)) for s, d, v in first)
    before = cache.partitions()
    done = cache.merge(rows(spark, [("a", 40, 7), ("a", 41, 8)]))
    assert len(done.partitions) == 1 and done.again == 0
    assert {p for p, v in cache.partitions().items() if before[p] != v} == set(done.partitions)
    assert held(cache.read()) == sorted([(s, d, float(v)) for s, d, v in first if (s, d) != ("a", 40)] + [("a", 40, 7.0), ("a", 41, 8.0)])
    cache.merge(rows(spark, [("a", 40, 9), ("z", 3, 2)]), prefer="old")
    assert ("a", 40, 7.0) in held(cache.read()) and ("z", 3, 2.0) in held(cache.read())
    assert held(cache.read(commit=1)) == sorted((s, d, float(v)) for s, d, v in first)  # earlier commits can be read
    assert held(cache.read("2019-02-01", "2019-02-10")) == [x for x in held(cache.read()) if 31 <= x[1] <= 40]
    assert cache.merge(rows(spark, [])).partitions == []
    with pytest.raises(ValueError, match="partition"):
        cache.merge(spark.createDataFrame([(None, at(0), 0.0, 0.0, 1.0)], CUBE))


def test_rows_that_go(spark, cache):
    cache.merge(rows(spark, [("a", 0, 1), ("a", 40, 2), ("b", 0, 3)]))
    gone = rows(spark, [("a", 40, 0), ("b", 5, 0)]).select("sector_id", "time")
    done = cache.merge(rows(spark, [("b", 1, 4)]), gone=gone)
    assert held(cache.read()) == [("a", 0, 1.0), ("b", 0, 3.0), ("b", 1, 4.0)]
    assert len(done.partitions) == 2 and len(cache.partitions()) == 2  # a partition without rows isn't one any more
    cache.merge(rows(spark, []), gone=cache.read().select("sector_id", "time"))
    assert cache.partitions() == {} and cache.read().count() == 0


def test_two_writers_lose_nothing(spark, cache):
    """Both start from the same commit: one comes second, in the same partition as well as in others."""
    cache.merge(rows(spark, [("a", 0, 1)]))
    other = partitioned.PartitionedCache(spark, cache.folder, CUBE, buckets=4)
    commit, met = cache.log.commit, []

    def slow(number, partitions):
        if not met:  # the other one commits just before
            met.append(other.merge(rows(spark, [("a", 1, 2), ("b", 50, 3)])))
        return commit(number, partitions)

    cache.log.commit = slow
    done = cache.merge(rows(spark, [("a", 2, 4), ("c", 70, 5), ("a", 0, 6)]))
    assert (met[0].commit, done.commit, done.again) == (2, 3, 1)
    assert held(cache.read()) == [("a", 0, 6.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 50, 3.0), ("c", 70, 5.0)]


def test_writers_at_once(spark, cache):
    failed = []

    def write(k):
        try:
            partitioned.PartitionedCache(spark, cache.folder, CUBE, buckets=4).merge(rows(spark, [(f"s{k}", d, k) for d in (0, 1)]))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert held(cache.read()) == sorted((f"s{k}", d, float(k)) for k in range(4) for d in (0, 1))


def test_vacuum(spark, cache):
    for v in range(3):
        cache.merge(rows(spark, [("a", 0, v), ("b", 0, v)]))
    assert cache.vacuum() == 0 and len(cache.log.numbers()) == 3
    assert cache.vacuum(grace=-1.0) == 2 and cache.log.numbers() == [3]
    assert held(cache.read()) == [("a", 0, 2.0), ("b", 0, 2.0)]
    cache.merge(rows(spark, [("a", 1, 9)]))
    assert cache.read().where(F.col("value") == 9).count() == 1


def test_stream_rewrites_touched_partitions(spark, cache, tmp_path):
    cache.merge(rows(spark, [("a", 0, 1), ("b", 60, 1)]))
    before = cache.partitions()
    rows(spark, [("a", 1, 2)]).write.parquet(f"file://{tmp_path}/in")
    stream = upserts.upsert_stream(spark.readStream.schema(CUBE).parquet(f"file://{tmp_path}/in"), cache)
    stream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert held(cache.read()) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 60, 1.0)]
    assert sum(before[p] != v for p, v in cache.partitions().items()) == 1


def test_whole_caches_notice_other_writers(spark, tmp_path):
    one, two = (tables.Cache(spark, f"file://{tmp_path}/whole", CUBE) for _ in range(2))
    one.write(rows(spark, [("a", 0, 1)]))
    mine, theirs = one.read(), two.read()
    two.write(theirs.unionByName(rows(spark, [("b", 0, 2)])))
    with pytest.raises(Conflict):
        one.write(mine.unionByName(rows(spark, [("c", 0, 3)])))
    one.write(one.read().unionByName(rows(spark, [("c", 0, 3)])))
    assert held(two.read()) == [("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, 3.0)]
    assert two.vacuum(grace=-1.0) == 3 and held(two.read()) == held(one.read())  # the lost version goes, too
