"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcube.sources.staging import Staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b): root is the least node that links reach.

    Every step hangs each node's larger neighbours, then its smaller ones, on the
    least of them, until nothing changes; the number of links never grows and the steps
    are about the logarithm of the longest chain. A node linked with itself alone is
    its own root; nulls link nothing.
    """
    staged = Staged(links.sparkSession, "components")
    nodes = links.where("a is not null and b is not null").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = staged.table(nodes)
    pairs = staged.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged.table(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("l")).select("l.*")
        pairs = staged.table(small.where("u <> v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return staged.table(nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root")))
