"""Intermediate tables, written once to the folder that all executors share (``spark.checkpoint.dir``) and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode a temporary one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Staged:
    """Tables of one run: :meth:`table` writes one, :meth:`drop` empties those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Empty all but the last ``keep`` tables, by Spark, as only Spark may reach the store."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            self.spark.range(0).write.mode("overwrite").parquet(path)
