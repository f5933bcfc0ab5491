"""Counts, tabs and the sentence that sum up a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import percent, plural
from ..functions.text import SPACE

#: What is counted, in the order of the sentence, and the tabs of the two modes.
LINES = (("text", "text change"), ("formatting", "formatting change"), ("tables", "table change"), ("visual", "page that looks different"), ("meaning", "paragraph with a meaning change"))
CONTENT_TABS, APPEARANCE_TABS = ("text", "tables", "meaning"), ("formatting", "visual")
PAGE_DIFFERS = 0.98


def visible_matches(matches: Column) -> Column:
    """The matches with a text that is not blank on either side; null texts are blank."""
    shown = lambda c: F.coalesce(c, F.lit("")).rlike(f"[^{SPACE}]")
    return F.filter(matches, lambda m: shown(m["original"]) | shown(m["modified"]))


def with_summary(counts: DataFrame) -> DataFrame:
    """counts (similarity, n_<tab>, has_<tab>) with total_changes, sentence, tabs, content_tabs, appearance_tabs and first_tab.

    n_<tab> are the changes of a layer, has_<tab> whether it ran with something to show; the text tab is always there.
    """
    n = {t: F.coalesce(F.col(f"n_{t}"), F.lit(0)) for t, _ in LINES}
    total = sum(n.values(), F.lit(0))
    parts = F.filter(F.array(*[F.when(n[t] > 0, F.concat_ws(" ", n[t].cast("string"), plural(F.lit(label), n[t]))) for t, label in LINES]), lambda s: s.isNotNull())
    joined = F.when(F.size(parts) <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", "), F.lit(" and "), F.element_at(parts, -1)))
    pct = F.regexp_replace(F.format_string("%.1f", percent(F.coalesce("similarity", F.lit(0.0)))), r"\.0$", "")
    start = F.concat(F.lit("These documents are "), pct, F.lit("% similar"))
    sentence = F.when(total == 0, F.concat(start, F.lit(" — no meaningful differences were found."))).otherwise(F.concat(start, F.lit(". We found "), joined, F.lit(".")))
    out = counts.withColumn("total_changes", total.cast("long")).withColumn("sentence", sentence)
    tabs = F.filter(F.array(*[F.when(F.lit(True) if t == "text" else F.coalesce(F.col(f"has_{t}"), F.lit(False)), t) for t, _ in LINES]), lambda t: t.isNotNull())
    out = out.withColumn("tabs", tabs)
    for mode, names in (("content_tabs", CONTENT_TABS), ("appearance_tabs", APPEARANCE_TABS)):
        out = out.withColumn(mode, F.array_intersect(F.array(*[F.lit(t) for t in names]), F.col("tabs")))
    return out.withColumn("first_tab", F.element_at("content_tabs", 1))
