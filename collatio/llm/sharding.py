"""Proportional stratified interleaving: every shard gets the corpus's mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

SHARDS, SEED = 24, 20240


def shard_rows(df: DataFrame, n_shards: int = SHARDS, stratum: str = "source", keys: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED, bits: int = 12) -> DataFrame:
    """df with ``shard`` and ``slot`` (gapless from 0 in each shard); columns of these names are replaced.

    Rows are shuffled by a seeded hash of ``keys`` and ranked within their stratum; the fractional rank
    (rank minus a phase of the stratum, over the stratum's rows) orders all rows, and the order is cut into
    shards whose row counts are at most one apart. No window holds a stratum or the table: rows are ranked
    within 2**bits hash ranges of each stratum, then within 4 * 2**bits ranges of the fractional rank, and the ranges' counts
    give the offsets. Null strata form a stratum of their own; null keys are hashed as they are; ties
    (repeated rows) fall in an order that does not matter, as they are equal; an empty table gives no rows.
    """
    given = df.drop("shard", "slot")
    names = {c: f"c_{i}" for i, c in enumerate(given.columns)}  # apart from the columns added here, whatever the given names
    own, stratum, keys = given.toDF(*names.values()), names[stratum], tuple(names[c] for c in keys)
    base = own.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n")).alias("__s"),
        F.xxhash64(F.lit(seed), *[F.col(c) for c in keys]).alias("__h"),
    ).withColumn("__b", F.shiftrightunsigned("__h", 64 - bits))
    sizes = base.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    within = Window.partitionBy("__s")
    sizes = sizes.select(
        "__s", "__b",
        F.coalesce(F.sum("__n").over(within.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(within).alias("__all"),
    )
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("__s")), 12) / F.lit(float(1 << 52))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h")) - 1
    ranked = base.join(sizes, ["__s", "__b"]).withColumn("__f", (rank + phase) / F.col("__all"))
    ranked = ranked.withColumn("__c", F.least(F.floor(F.col("__f") * (4 << bits)), F.lit((4 << bits) - 1)))
    everywhere = Window.orderBy("__c")
    offsets = ranked.groupBy("__c").agg(F.count("*").alias("__n"))
    offsets = offsets.select(  # as many rows as there are ranges, however many documents
        "__c",
        F.coalesce(F.sum("__n").over(everywhere.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__rows"),
    )
    place = F.col("__off") + F.row_number().over(Window.partitionBy("__c").orderBy("__f", "__s", "__h")) - 1
    placed = ranked.join(offsets, "__c").withColumn("__pos", place)
    placed = placed.withColumn("shard", F.expr(f"cast((__pos * {n_shards}) div __rows as int)"))
    placed = placed.withColumn("slot", F.expr(f"__pos - (shard * __rows + {n_shards - 1}) div {n_shards}"))
    return placed.select(*[F.col(to).alias(c) for c, to in names.items()], "shard", "slot")


def sharded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in shards 0 to 23 under the law ``rows``. Null text counts as empty."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(docs, SHARDS, "source", ("doc_id", "text_hash"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
