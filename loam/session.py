"""Sessions, and the package on the executors."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate tables in the folder of spark.checkpoint.dir, which driver and executors share; where it is unset, in a temporary one if they are one process, else an error. It goes when the application ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/loam-{uuid.uuid4().hex}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    return path


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage; in folders by partitions, if there are any."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: work of a millisecond a row shouldn't wait for the one task of a small file. Larger inputs stay as they are, without a shuffle.
    With each, in tasks of about so many rows, however large it is; rows are dealt by keys, where there are any, which spares the sort of dealing in turn. A table of files is counted from their footers."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    if each:
        parts *= max(1, -(-df.count() // (each * parts)))  # no core waits for others at the end
    return df.repartition(parts, *keys) if df.rdd.getNumPartitions() < parts else df


def session(app: str = "loam", master: str | None = None) -> SparkSession:
    """A session with what the operators assume: UTC, AQE and small-side thresholds of Spark."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="loam-"), "loam"), "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
