"""Results that several later steps read, kept in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. Where it is unset, a temporary one on a local
    master and an error on any other."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="quantloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it lies."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables written to a folder of the shared one, for loops: unlike a checkpoint a table has the size that it has, and
    not the product of all sizes that were joined for it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def forget(self, before: int) -> None:
        """Removes all but the last tables, from the `before`-th on."""
        for path in self.paths[:before]:
            remove_dir(self.spark, path)
        del self.paths[:before]

    def close(self) -> None:
        remove_dir(self.spark, self.folder)
