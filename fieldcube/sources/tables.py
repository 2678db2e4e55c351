"""Caches as Parquet tables: versions that readers never see half written, and results as JSON or CSV."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcube.sources.commits import CommitLog, Conflict

class Cache:
    """A table below a folder. Every write makes a new version; a commit, written last, names the one that counts.

    A version is read while the next one is written, so a table can be rewritten
    from itself, and a failed write leaves the old one. If another writer has committed
    since this object read the table last, a write fails with :class:`Conflict` and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, partitions: Sequence[str] = ()):
        self.spark, self.folder, self.schema, self.partitions = spark, folder.rstrip("/"), schema, list(partitions)
        self.log, self._base = CommitLog(spark, folder), None

    def version(self) -> str | None:
        """The version that counts now, which writes then go out from."""
        self._base = self.log.last()
        return self.log.read(self._base)["version"] if self._base else None

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}")

    def _typed(self, df: DataFrame) -> DataFrame:
        """The cache's columns in its types."""
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema])

    def write(self, df: DataFrame) -> str:
        base = self.log.last() if self._base is None else self._base
        version = f"v-{uuid.uuid4().hex}"
        rows = self._typed(df)
        rows = rows.repartition(*self.partitions) if self.partitions else rows
        rows.write.partitionBy(*self.partitions).parquet(f"{self.folder}/{version}")
        if not self.log.commit(base + 1, {"version": version}):
            raise Conflict(f"{self.folder} was written by another writer since it was read")
        self._base = base + 1
        return version

    def vacuum(self, grace: float = 86400.0) -> int:
        """Remove versions replaced over ``grace`` seconds ago; see :meth:`CommitLog.vacuum`."""
        return self.log.vacuum(lambda content: [content["version"]], grace)


def as_json(df: DataFrame, column: str = "record") -> DataFrame:
    """Rows as JSON text with explicit nulls; NaN and infinities are null too."""
    kinds = dict(df.dtypes)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.select(F.to_json(F.struct(*[finite(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias(column))


def save(df: DataFrame, path: str, save_format: str = "parquet") -> None:
    """Write as parquet or csv."""
    if save_format not in ("parquet", "csv"):
        raise ValueError(f"unknown format {save_format}")
    df.write.format(save_format).option("header", "true").save(path)


def layers(spark: SparkSession, folder: str, names: Sequence[str], file_format: str = "parquet") -> list[DataFrame]:
    """The named layers of a vector data set, one table each."""
    return [spark.read.format(file_format).load(f"{folder}/{n}") for n in names]


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def listing(spark: SparkSession) -> list[str]:
    """The catalogue's tables; paths from outside never reach the file system."""
    return sorted(t.name for t in spark.catalog.listTables())
