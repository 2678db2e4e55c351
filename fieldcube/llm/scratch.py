"""Intermediate tables in the folder that all executors share.

A written table cuts lineage: losing an executor costs its running tasks, not
the work before the table. The tables belong to the session that made them; its
results read them, so :func:`clear` comes after these are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables made by this driver.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; ``by``: its last column, which becomes folders."""
    return written(df, name, by)[0]


def written(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """:func:`table`, and its folder for :func:`drop`."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Empty a table's folder, by Spark, as only Spark may reach the store."""
    spark.range(0).write.mode("overwrite").parquet(path)
    _made.remove(path)


def clear(spark: SparkSession) -> int:
    """Empty the folders made so far; how many. Results that still read them can't be computed again."""
    gone = list(_made)
    for path in gone:
        drop(spark, path)
    return len(gone)
