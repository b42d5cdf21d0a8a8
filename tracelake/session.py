"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on, on request: UTC clocks and a split layout that two reads of one file agree on.

    ``spark.sql.files.minPartitionNum`` otherwise follows the number of live cores, so the splits of a
    small file could change between two scans of one job while executors come and go. No reader calls this.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back from the shared folder.

    The folder belongs to the caller's checkpoint folder and lives as long as that is kept; :func:`discard` removes
    one earlier.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that :func:`materialize` gave, once nothing reads it any more."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        return
    plain = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if plain(folder).startswith(plain(base)) and plain(folder) != plain(base):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
