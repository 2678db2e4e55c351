"""Acquisitions that arrive as a stream: an extension, as the batch service has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fieldcube.operators import sync
from fieldcube.sources.partitioned import PartitionedCache
from fieldcube.sources.tables import Cache


def upsert_stream(arrivals: DataFrame, cache: Cache | PartitionedCache, keys: tuple[str, ...] = ("sector_id", "time"), prefer: str = "new") -> DataStreamWriter:
    """A writer that upserts every micro-batch into a cache; a batch that runs twice gives the same cache. A cache in partitions has only those rewritten that a batch touches."""

    def one(batch: DataFrame, _: int) -> None:
        if isinstance(cache, PartitionedCache):
            cache.merge(batch, prefer, keys)
        else:
            cache.write(sync.upsert(cache.read(), batch, prefer, keys))

    return arrivals.writeStream.foreachBatch(one)


def daily_means(arrivals: DataFrame, value: str, late: str = "2 days") -> DataFrame:
    """(sector_id, day, mean, n) of a stream of pixels; a day closes ``late`` after the last time seen."""
    marked = arrivals.withWatermark("time", late)
    days = marked.groupBy("sector_id", F.window("time", "1 day").alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return days.select("sector_id", F.to_date("w.start").alias("day"), "mean", "n")
