"""Composites and growth kept as caches: what a change of the bands leaves as it was isn't computed again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcube import schema
from fieldcube.functions import indices
from fieldcube.operators import growth
from fieldcube.sources.partitioned import PartitionedCache
from fieldcube.sources.staging import Staged

INSTANT = ["sector_id", "time"]


@dataclass
class Derived:
    """The caches of composites (one column each) and of growth."""

    composites: PartitionedCache
    growth: PartitionedCache

    @classmethod
    def at(cls, spark: SparkSession, folder: str, names: Sequence[str]) -> Derived:
        """The caches below a folder; growth needs ndvi, which is always kept."""
        columns = "".join(f", {n} double" for n in sorted({*names, "ndvi"}))
        return cls(PartitionedCache(spark, f"{folder}/composites", schema.PIXEL + columns, span="yyyy"), PartitionedCache(spark, f"{folder}/growth", schema.PIXEL + ", ags double", span="yyyy"))


def changed_instants(bands: DataFrame, composites: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """The instants at which the two cubes don't have the same number of cells, and those of ``also`` (rows replaced in place)."""
    count = lambda df, name: df.groupBy(*INSTANT).agg(F.count(F.lit(1)).alias(name))
    found = count(bands, "n").join(count(composites, "m"), INSTANT, "full").where("not n <=> m").select(*INSTANT)
    return found if also is None else found.unionByName(also.select(*INSTANT)).distinct()


def refresh(store: Derived, bands: DataFrame, replaced: DataFrame | None = None, min_obs: int = 8) -> dict[str, DataFrame]:
    """Bring both caches up to the bands' cache; composites and growth as they are then, and ``computed``: the rows of growth that were.

    ``replaced``: instants whose rows changed in the bands' cache. Composites are computed for
    changed instants alone, growth for the times whose windows hold one, and of both caches only
    the partitions of these are written. Running it again computes nothing.
    """
    tables = Staged(bands.sparkSession, "derived")
    old = store.composites.read()
    changed = tables.table(changed_instants(bands, old, replaced))
    names = [c for c in old.columns if c in indices.RULES]
    made = indices.composites(bands.join(changed, INSTANT, "left_semi"), names)
    store.composites.merge(made.select(*old.columns), gone=changed)
    composites = store.composites.read()
    done, gone = growth.refreshed(composites.select(*INSTANT, "y", "x", "ndvi"), store.growth.read(), changed, "ndvi", min_obs)
    computed = tables.table(done)
    store.growth.merge(computed, keys=(*INSTANT, "y", "x"), gone=gone)
    return {"composites": composites, "growth": store.growth.read(), "computed": computed}
