"""Tiers, bands and display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest similarity of each tier; below the last it is a major change.
TIERS = (("minor_wording_change", 0.95), ("semantically_similar", 0.80), ("meaningful_change", 0.55))
MAJOR = "major_change"
CLOSE = 0.05
MATCH_TYPES = ("exact_match", *(t for t, _ in TIERS), MAJOR, "added", "removed")
#: Display texts.
MATCH_LABELS = {
    "exact_match": "Exact match", "minor_wording_change": "Minor wording change", "semantically_similar": "Semantically similar",
    "meaningful_change": "Meaningful change", "major_change": "Major change", "added": "Added", "removed": "Removed",
}
TAB_LABELS = {"text": "Text", "formatting": "Formatting", "tables": "Tables", "visual": "Pages", "meaning": "Meaning"}


def banded(value: Column, bands, rest: str) -> Column:
    out = F
    for name, least in bands:
        out = out.when(value >= F.lit(least), name)
    return out.otherwise(rest)


def tier(similarity: Column) -> Column:
    return banded(similarity, TIERS, MAJOR)


def confidence(similarity: Column) -> Column:
    """``low`` within CLOSE of a tier's boundary, else ``high``."""
    nearest = F.least(*[F.abs(similarity - F.lit(t)) for _, t in TIERS])
    return F.when(nearest > F.lit(CLOSE), "high").otherwise("low")


def rounded(value: Column, digits: int) -> Column:
    """Python's round: exact binary value, ties to even. Doubles go through a decimal of 30 places, which holds all that matters."""
    return F.bround(value.cast("decimal(38,30)"), digits).cast("double")


def percent(similarity: Column) -> Column:
    """A share as percent with one digit, halves up, as the summary and the meter show it."""
    return F.floor(similarity * 1000 + 0.5) / 10


def meter_band(similarity: Column) -> Column:
    return banded(percent(similarity), (("high", 90), ("medium", 60)), "low")


def page_colour(similarity: Column) -> Column:
    return banded(similarity, (("match", 0.98), ("close", 0.90)), "different")


def page_confidence(score: Column) -> Column:
    return banded(score, (("identical", 99), ("near identical", 95), ("similar", 90)), "different")


def labelled(value: Column, texts: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[value], value)


def plural(label: Column, n: Column) -> Column:
    return F.when(n == 1, label).otherwise(F.concat(label, F.lit("s")))


def shown_value(prop: Column, value: Column) -> Column:
    """A formatting value as the formatting view shows it; values come as text."""
    flags = F.when(value == "true", "on").when(value == "false", "off")
    return F.when(value.isNull(), "default").when(prop.isin("bold", "italic", "underline"), flags).when(prop == "size", F.concat(value, F.lit("pt"))).when(prop == "color", F.concat(F.lit("#"), value)).otherwise(value)
