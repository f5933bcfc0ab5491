"""Jobs as tables: two documents and at most one result each; a job's state follows from its data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_view(jobs: DataFrame, documents: DataFrame, results: DataFrame) -> DataFrame:
    """One row a job (id, original_id, modified_id, status, error_message) with its file names, and its result's fields only when it is done."""
    doc = lambda side: documents.select(F.col("id").alias(f"{side}_id"), F.col("filename").alias(f"{side}_filename"))
    fields = [c for c in results.columns if c != "job_id"]
    out = jobs.join(doc("original"), "original_id").join(doc("modified"), "modified_id").join(results.withColumnRenamed("job_id", "id"), "id", "left")
    done = F.col("status") == "done"
    return out.select("id", "status", F.when(F.col("status") == "failed", F.col("error_message")).alias("error_message"), "original_filename", "modified_filename", *[F.when(done, F.col(c)).alias(c) for c in fields])
