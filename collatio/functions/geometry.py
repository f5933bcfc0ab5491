"""Page sizes, difference regions and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paper sizes in points, short and long side, in order of preference.
PAPER = (("Letter", 612.0, 792.0), ("A4", 595.3, 841.9), ("Legal", 612.0, 1008.0), ("Tabloid", 792.0, 1224.0), ("A3", 841.9, 1190.6), ("Executive", 522.0, 756.0))
SLACK = 6.0
GAP_X, GAP_Y = 24, 8
DEFAULT_CANVAS = (1224, 1584)


def paper_size(width: Column, height: Column) -> Column:
    """Name and orientation of a page; a page of no known size is named by its rounded sides. A square is portrait."""
    short, long = F.least(width, height), F.greatest(width, height)
    name = F
    for paper, w, h in PAPER:
        name = name.when((F.abs(short - F.lit(w)) <= SLACK) & (F.abs(long - F.lit(h)) <= SLACK), paper)
    name = name.otherwise(F.format_string("%dx%d pt", F.bround(width, 0).cast("long"), F.bround(height, 0).cast("long")))
    return F.concat(name, F.when(width > height, " (Landscape)").otherwise(" (Portrait)"))


def region_type(w: Column, h: Column, count: Column) -> Column:
    density = count / F.greatest(w * h, F.lit(1))
    ruled = ((w > 100) & (h <= 8)) | ((h > 100) & (w <= 8))
    return F.when(ruled, "table").when((h <= 48) & (w >= 6), "text").when((h > 48) & (w > 60) & (density > 0.25), "image").otherwise("layout")


def region_severity(w: Column, h: Column, count: Column, page_w: Column, page_h: Column) -> Column:
    return F.when((count > 400) | (w * h > page_w * page_h * F.lit(0.05)), "high").when(count >= 70, "medium").otherwise("low")


def canvas_percent(value: Column, canvas: Column, default: int) -> Column:
    return value / F.coalesce(canvas, F.lit(default)) * 100


def merged_boxes(boxes: str, gap_x: int = GAP_X, gap_y: int = GAP_Y) -> Column:
    """Boxes (struct of min_y, min_x, max_y, max_x, n) merged in one pass from top left: each joins the first cluster within the gaps, which grows; clusters never meet again."""
    near = f"c.min_y <= b.max_y + {gap_y} AND b.min_y <= c.max_y + {gap_y} AND c.min_x <= b.max_x + {gap_x} AND b.min_x <= c.max_x + {gap_x}"
    grown = "named_struct('min_y', least(c.min_y, b.min_y), 'min_x', least(c.min_x, b.min_x), 'max_y', greatest(c.max_y, b.max_y), 'max_x', greatest(c.max_x, b.max_x), 'n', c.n + b.n)"
    at = f"array_position(transform(cs, c -> {near}), true)"
    order = "(l, r) -> CASE WHEN l.min_y < r.min_y THEN -1 WHEN l.min_y > r.min_y THEN 1 WHEN l.min_x < r.min_x THEN -1 WHEN l.min_x > r.min_x THEN 1 ELSE 0 END"
    return F.expr(f"aggregate(array_sort({boxes}, {order}), slice({boxes}, 1, 0), (cs, b) -> IF({at} = 0, concat(cs, array(b)), transform(cs, (c, i) -> IF(i = {at} - 1, {grown}, c))))")
