"""Files that arrive in a folder, extracted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parsers import extracted


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (filename, content, doc)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path)
    return extracted(files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content"))
