"""Remote providers as Spark data sources.

A source splits a request into one partition per sector and range of days. What
goes over the wire is a transport's affair: a class named by the option
``transport`` ("module:Class"), made on the executor, whose ``fetch`` gets the
partition's options and returns rows. Tests and offline work use recorded answers.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldcube import schema

# The providers' parameters that pass on.
ALLOWED = ("biopar_type", "bands", "collection", "process")


def retried(call: Callable[[], list], retries: int, wait: float, skip: bool = False) -> list:
    """``call`` again after a failure, ``retries`` times at most; then the failure, or with ``skip`` nothing: a range without rows stays a gap, which is asked for again later."""
    for k in range(retries + 1):
        try:
            return call()
        except OSError:
            if k == retries and not skip:
                raise
            if k < retries:
                time.sleep(wait * 2**k)
    return []


class Range(InputPartition):
    """A sector and a range of days."""

    def __init__(self, sector_id: str, start: str, end: str):
        self.sector_id, self.start, self.end = sector_id, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = dict(options), columns

    def partitions(self) -> list[Range]:
        return [Range(*x) for x in json.loads(self.options["ranges"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), name)(self.options)
        asked = {"sector_id": partition.sector_id, "start": partition.start, "end": partition.end} | {k: self.options[k] for k in ALLOWED if k in self.options}
        for row in retried(lambda: list(transport.fetch(asked)), int(self.options.get("retries", 1)), float(self.options.get("wait", 5)), self.options.get("failures") == "skip"):
            yield tuple(row.get(c) for c in self.columns)


class _Source(DataSource):
    KIND, SCHEMA = "", ""

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.fieldNames())


class SatelliteSource(_Source):
    """Acquisitions: one row a raster file, with a NULL payload for a day known to be empty."""

    KIND, SCHEMA = "fieldcube_satellite", schema.ACQUISITION


class WeatherSource(_Source):
    """Weather responses: a start, an end, an interval in seconds, and values by variable."""

    KIND, SCHEMA = "fieldcube_weather", "sector_id string, start long, end long, interval long, variables map<string, array<double>>"


class RadiationSource(_Source):
    """Answers of the radiation service as JSON text."""

    KIND, SCHEMA = "fieldcube_radiation", "sector_id string, payload string"


def scan(spark: SparkSession, source: type[_Source], transport: str, ranges: list[tuple[str, str, str]], **options: str) -> DataFrame:
    """Rows of a provider for (sector_id, start, end) ranges, one task a range; option ``failures`` = "skip" passes over ranges that fail."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.KIND).option("transport", transport).option("ranges", json.dumps(ranges))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
