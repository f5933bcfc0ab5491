"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from collatio import queries
from collatio.operators import matching

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["token_counts", "exact_paragraph_matches", "document_order", "semantic_matches", "word_diff_stats", "tfidf_cosine", "vector_cosine_topk", "table_row_diff", "table_row_diff_aligned", "dominant_format", "property_changes", "region_class", "merge_boxes", "summary_sentence"]


def one_pair(spark: SparkSession, sf_dir: str):
    """The published case: 120 paragraphs of 10 to 11 words, every fifth changed."""
    lines = [f"Clause {i}: the supplier shall deliver item number {i} on schedule." for i in range(120)]
    other = [x.replace("shall deliver", "must provide") if i % 5 == 0 else x for i, x in enumerate(lines)]
    return matching.semantic_matches(spark.createDataFrame([(1, "\n\n".join(lines), "\n\n".join(other))], "pair_id long, original string, modified string"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = {n: queries.QUERIES[n] for n in HEADLINE} | {"one_pair_120_paragraphs": one_pair}
    one_pair(spark, SF).write.format("noop").mode("overwrite").save()  # starts the workers
    seconds = {}
    for name, f in run.items():
        began = time.time()
        f(spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    documents = queries.read(spark, SF, "documents").agg(F.count("*")).first()[0]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF.rstrip("/").rpartition("/")[2], "cpus": int(CPUS), "documents": documents}))


if __name__ == "__main__":
    main()
