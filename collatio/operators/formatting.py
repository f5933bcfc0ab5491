"""Paragraph formatting: dominant run properties, and their differences between paired paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import exact_matches, greedy_pairs, unmatched
from .similarity import provider

PROPERTIES = ("font", "size", "bold", "italic", "underline", "color")
FLOOR = 0.5
STATS = ("unchanged", "changed", "added", "removed")
#: Span flags of the PDF text layer.
ITALIC_BIT, BOLD_BIT = 1 << 1, 1 << 4


def dominant(values: Column) -> Column:
    """The most frequent value of an array that is not null, the first seen among equals; null if there is none."""
    some = F.filter(values, lambda v: v.isNotNull())
    ranked = F.transform(F.array_distinct(some), lambda v, i: F.struct(F.size(F.filter(some, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(ranked)["v"]


def paragraph_formats(runs: DataFrame, keys: list[str] = ["pair_id", "side", "idx"], order: str = "run_idx") -> DataFrame:  # noqa: B006
    """One row a paragraph from its runs (keys, run_idx, text, font, size, bold, italic, underline, color); blank paragraphs are left out. One shuffle."""
    flags = ("bold", "italic", "underline")
    rows = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "text", "font", "size", "color"))).alias("__runs"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags])
    rows = rows.withColumn("text", F.array_join("__runs.text", "")).where(F.trim("text") != "")
    return rows.select(*keys, "text", *[F.col(c) if c in flags else dominant(F.col(f"__runs.{c}")).alias(c) for c in PROPERTIES])


def span_formats(spans: DataFrame) -> DataFrame:
    """PDF spans (.., size, flags, color as a number) as runs: size to one digit, flag bits, six hex digits; never underlined."""
    return spans.select(
        *[c for c in spans.columns if c not in ("size", "flags", "color")],
        F.bround("size", 1).alias("size"), F.col("flags").bitwiseAND(BOLD_BIT).cast("boolean").alias("bold"), F.col("flags").bitwiseAND(ITALIC_BIT).cast("boolean").alias("italic"),
        F.lit(False).alias("underline"), F.when(F.col("color").isNotNull(), F.format_string("%06X", F.col("color"))).alias("color"),
    )


def as_text(c: str) -> Column:
    return F.col(c).cast("string")


def property_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prop, from_value, to_value) for each property that differs between o_<prop> and m_<prop>; two nulls are equal."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("prop"), as_text(f"o_{p}").alias("from_value"), as_text(f"m_{p}").alias("to_value")) for i, p in enumerate(PROPERTIES)])
    return pairs.select(*keys, F.inline(each)).where(~F.col("from_value").eqNullSafe(F.col("to_value"))).drop("i")


def compare_formats(parts: DataFrame, similarity: str | None = None) -> DataFrame:
    """One row a change of paragraphs (pair_id, side, idx, text, properties): out_idx, type, texts, changed_properties.

    Order: exact pairs by place, similar pairs (0.5 or more) by falling similarity, removed, added. Pairs whose properties agree are unchanged.
    """
    exact = exact_matches(parts).select("pair_id", "o_idx", "m_idx", F.lit(0).alias("kind"), F.lit(1.0).alias("sim"))
    left = unmatched(parts)
    greedy = greedy_pairs(provider(parts, similarity)[1](left), FLOOR).select("pair_id", "o_idx", "m_idx", F.lit(1).alias("kind"), "sim")
    rest = lambda s: left.where(F.col("side") == s).select("pair_id", F.col("idx").alias(f"{s}_idx")).join(greedy.select("pair_id", f"{s}_idx"), ["pair_id", f"{s}_idx"], "left_anti")
    removed = rest("o").select("pair_id", "o_idx", F.lit(None).cast("int").alias("m_idx"), F.lit(2).alias("kind"), F.lit(0.0).alias("sim"))
    added = rest("m").select("pair_id", F.lit(None).cast("int").alias("o_idx"), "m_idx", F.lit(3).alias("kind"), F.lit(0.0).alias("sim"))
    rows = exact.unionByName(greedy).unionByName(removed).unionByName(added)
    side = lambda s: parts.where(F.col("side") == s).select("pair_id", F.col("idx").alias(f"{s}_idx"), F.col("text").alias(f"{s}_text"), *[F.col(p).alias(f"{s}_{p}") for p in PROPERTIES])
    rows = rows.join(side("o"), ["pair_id", "o_idx"], "left").join(side("m"), ["pair_id", "m_idx"], "left")
    changes = F.filter(F.array(*[F.struct(F.lit(p).alias("prop"), as_text(f"o_{p}").alias("from_value"), as_text(f"m_{p}").alias("to_value")) for p in PROPERTIES]), lambda c: ~c["from_value"].eqNullSafe(c["to_value"]))
    rows = rows.withColumn("changed_properties", F.when(F.col("kind") < 2, changes))
    kind = F.when(F.col("kind") == 2, "removed").when(F.col("kind") == 3, "added").when(F.size("changed_properties") > 0, "changed").otherwise("unchanged")
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("kind", F.col("sim").desc(), F.coalesce("o_idx", "m_idx"), "m_idx")) - 1
    return rows.select("pair_id", place.alias("out_idx"), kind.alias("type"), F.col("o_text").alias("original_text"), F.col("m_text").alias("modified_text"), "changed_properties")


def format_stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("pair_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in STATS])
