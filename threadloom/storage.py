"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; a local folder only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or os.path.join(tempfile.gettempdir(), "threadloom-shared")).rstrip("/")


def staged(df: DataFrame, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """The table written once to the shared folder and read back.

    This cuts lineage and survives lost executors. The files go when the application ends.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/threadloom/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores where its files give fewer tasks than that (small tables in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if tasks < cores else df
