"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir), and small inputs dealt over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Only a local master, whose executors are the driver, gets a temporary folder where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="collatio-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/collatio-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read again: what follows does not compute it anew, and lost executors cost nothing of it. The table goes when the session's JVM ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """df, dealt anew if it has fewer parts than ``per_core`` for each core: a small table in one file of few row groups would keep most cores idle. Large tables have more parts and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(per_core * cores) if df.rdd.getNumPartitions() < per_core * cores else df
