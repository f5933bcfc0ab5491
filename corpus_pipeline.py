"""A training corpus from ``documents``: quality rules, near copies, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm import decontam, jaccard, packing, quality, substrings
from collatio.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go. Null texts fail the base; repeated rows share a verdict."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    out = quality.judged(docs, table(spark, sf_dir, "labels"), keep).where("s_kept")
    names = {c: f"k_{i}" for i, c in enumerate(keep)} | {"doc_id": "doc_id"}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id."""
    return jaccard.one_of_each(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that stand elsewhere too go from the texts; n_chars follows. A text of which nothing is left stays, empty."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substrings.deduplicated(docs, keep, texts=True)
    names = {c: F.col(f"k_{i}") for i, c in enumerate(keep)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in names:
        names["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(names["n_chars"])
    return out.select(*[names[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, with their ids."""
    return packing.packed(docs, packing.default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", token_packing),
]

#: The forest, the SimHash and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
