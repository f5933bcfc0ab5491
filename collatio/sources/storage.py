"""Bytes by key, result tables and schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the keys under which difference images are served.
KEY = r"^diffs/[0-9a-fA-F\-_]+\.png$"


def servable(key: Column) -> Column:
    """Only difference images may be served."""
    return key.rlike(KEY) & ~key.contains("\n")


def diff_key(content: Column, suffix: str = "") -> Column:
    """A key by content, so that equal images share one and a rerun writes the same keys."""
    d = F.sha2(content, 256)
    parts = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("diffs/"), F.concat_ws("-", *parts), F.lit(f"_{suffix}.png" if suffix else ".png"))


def put_objects(objects: DataFrame, path: str) -> None:
    """Writes (key, content) as a table, one row a key."""
    objects.select("key", "content").dropDuplicates(["key"]).write.mode("append").option("compression", "zstd").parquet(path)


def get_objects(spark, path: str, keys: DataFrame | None = None) -> DataFrame:
    stored = spark.read.schema("key string, content binary").parquet(path)
    return stored if keys is None else stored.join(keys.select("key").distinct(), "key", "left_semi")


def write_results(results: DataFrame, path: str, run: str) -> None:
    """One commit a run; a job's status follows from its row."""
    results.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def missing_columns(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, missing) for tables that exist but lack expected columns (table_name, column_name); new tables are left out."""
    known = expected.join(actual.select("table_name").distinct(), "table_name", "left_semi")
    gone = known.join(actual, ["table_name", "column_name"], "left_anti")
    return gone.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("missing"))
