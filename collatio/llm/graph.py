"""Connected components of an edge table by alternating large and small stars, cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_among, hot_from, salted, written


def _least(rows: DataFrame, total: int | None) -> DataFrame:
    """rows (u, v) with ``m``, the least v of their u; with ``total`` rows of a u that has very many are dealt over several tasks."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__c"))
    return salted(rows, least.drop("__c"), ["u"], None if total is None else least.where(F.col("__c") > hot_from(total)), ["v"])


def _large(e: DataFrame, total: int | None) -> DataFrame:
    both = _least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), total)
    return both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()


def _small(e: DataFrame, total: int | None) -> DataFrame:
    onto = _least(e, total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
    return onto.select("s.u", "s.v").where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v), root being the least node of its component.

    No group of neighbours is gathered: both stars are an aggregate with partial sums and an equality join, in which
    the rows of a node with very many neighbours are dealt over several tasks. The edges never outnumber those given.
    """
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now = written(oriented, "edges", "snappy")
    was = mark(now)
    while was[0]:
        # No node has more neighbours than there are edges, so few edges need no look at them.
        degrees = now.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("c"))
        total = was[0] if was[0] > hot_from(was[0]) and hot_among(degrees, "c", was[0]) is not None else None
        now = written(_small(_large(now, total), total), "edges", "snappy")
        new = mark(now)
        if new == was:
            break
        was = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
