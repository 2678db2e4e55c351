"""Cubes kept in partitions of sectors and months, of which a merge rewrites those it touches.

A commit names the version of each partition. Versions are written first; if another
writer commits before, the merge takes in what was changed: so no reader sees half a write and no
writer's rows are lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcube.operators import sync
from fieldcube.sources.commits import CommitLog
from fieldcube.sources.staging import Staged


#: Rows that come to a partition on average, above which it is written as several files.
FILE_ROWS = 2_000_000


@dataclass(frozen=True)
class Merge:
    """What a merge did: its commit's number, the partitions rewritten, and how often it had to start again."""

    commit: int
    partitions: list[str]
    again: int


class PartitionedCache:
    """A cube below a folder. ``buckets`` of sectors and the months of times are its partitions; it stays as it was made."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 16, span: str = "yyyy-MM"):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        self.span = span  # of times: months, or "yyyy" for caches with few rows a month
        self.fields = T.StructType(spark.createDataFrame([], schema).schema.fields)
        self.log = CommitLog(spark, folder)

    def partitions(self, commit: int | None = None) -> dict[str, str]:
        """Each partition's version in a commit, the last one if none is named."""
        number = commit or self.log.last()
        return self.log.read(number) if number else {}

    # Rows

    def _where(self) -> list[Column]:
        return [F.pmod(F.xxhash64("sector_id"), F.lit(self.buckets)).cast("int").alias("bucket"), F.date_format("time", self.span).alias("month")]

    def _load(self, partitions: dict[str, str]) -> DataFrame:
        if not partitions:
            return self.spark.createDataFrame([], self.fields)
        return self.spark.read.schema(self.fields).parquet(*[f"{self.folder}/{version}/{name}" for name, version in sorted(partitions.items())])

    def read(self, start: str | None = None, end: str | None = None, commit: int | None = None) -> DataFrame:
        """All rows, or those of a closed range of days, whose months alone are opened."""
        found = self.partitions(commit)
        month = lambda name: name.rpartition("=")[2]
        found = {k: v for k, v in found.items() if (start is None or month(k) >= start[: len(self.span)]) and (end is None or month(k) <= end[: len(self.span)])}
        rows, day = self._load(found), F.to_date("time")
        rows = rows if start is None else rows.where(day >= F.to_date(F.lit(start)))
        return rows if end is None else rows.where(day <= F.to_date(F.lit(end)))

    def merge(self, rows: DataFrame, prefer: str = "new", keys: Sequence[str] = ("sector_id", "time"), gone: DataFrame | None = None) -> Merge:
        """Upsert rows (see :func:`sync.upsert`): only partitions with one of them are read and written.

        Rows of the cache that have the columns of ``gone`` (sector_id and time among them) are
        taken out first. If another writer commits before this one, partitions that it didn't touch keep what was
        written; the others are merged with its rows. Rows without a sector or time are refused.
        """
        staged = Staged(self.spark, "merge")
        rows = staged.table(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields]))
        if not rows.where("sector_id is null or time is null").isEmpty():
            raise ValueError("rows without a sector or a time have no partition")
        places = rows.select(*self._where())
        if gone is not None:
            kinds = {f.name: f.dataType for f in self.fields}
            gone = staged.table(gone.select(*[F.col(c).cast(kinds[c]).alias(c) for c in gone.columns]).distinct())
            places = places.unionByName(gone.select(*self._where()))
        touched = sorted(f"bucket={r['bucket']}/month={r['month']}" for r in places.distinct().collect())  # buckets * months at most
        spread = max(1, rows.count() // (max(1, len(touched)) * FILE_ROWS))  # files a partition, so that a large one isn't one task
        number, again = self.log.last(), 0
        base = self.partitions(number)
        made: dict[str, str | None] = {}
        seen: dict[str, str | None] = {}
        if not touched:
            staged.drop()
            return Merge(number, [], 0)
        while True:
            todo = [p for p in touched if p not in made or seen[p] != base.get(p)]
            if todo:
                old = self._load({p: base[p] for p in todo if p in base})
                old = old if gone is None else old.join(gone, gone.columns, "left_anti")
                names = F.concat(F.lit("bucket="), self._where()[0].cast("string"), F.lit("/month="), self._where()[1])
                version = f"v-{uuid.uuid4().hex}"
                done = sync.upsert(old, rows.where(names.isin(*todo)), prefer, keys).select(*self.fields.names, *self._where())
                done.repartition("bucket", "month", F.pmod(F.xxhash64("sector_id", "time"), F.lit(spread))).write.partitionBy("bucket", "month").parquet(f"{self.folder}/{version}")
                made |= {p: version if gone is None or self.log.exists(f"{version}/{p}") else None for p in todo}  # None: nothing is left
                seen |= {p: base.get(p) for p in todo}
            if self.log.commit(number + 1, {p: v for p, v in (base | made).items() if v is not None}):
                staged.drop()
                return Merge(number + 1, touched, again)
            again += 1
            number = self.log.last()
            base = self.partitions(number)

    def vacuum(self, grace: float = 86400.0) -> int:
        """Remove what was replaced over ``grace`` seconds ago; see :meth:`CommitLog.vacuum`."""
        return self.log.vacuum(lambda content: content.values(), grace)
