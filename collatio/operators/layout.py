"""Where the lines of a Word document stand on pages, estimated without fonts; drawing them is a provider's task."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYOUT = "page int, x double, y double, width double, text string, size double, bold boolean, italic boolean, color string, kind string"
#: Fixed values, in points: line height and mean character width by font size, gaps and table rows.
LEADING, CHARACTER, FEWEST = 1.35, 0.52, 10
BLANK, AFTER, BEFORE_TABLE, ROW, CELL_CHARACTER, CELL_SIZE = 12.0, 4.0, 8.0, 20.0, 6, 9.0


@dataclass
class Page:
    """Sides and margins in points; the cursor runs down a page and goes on at the top of the next."""

    width: float = 612.0
    height: float = 792.0
    left: float = 72.0
    top: float = 72.0
    right: float = 72.0
    bottom: float = 72.0
    number: int = field(default=1, init=False)
    y: float = field(default=0.0, init=False)

    def __post_init__(self):
        self.y = self.top

    @property
    def usable(self) -> float:
        return max(self.width - self.left - self.right, 100.0)

    def room(self, height: float) -> float:
        """The place of the next block of this height, on a new page if it does not fit."""
        if self.y + height > self.height - self.bottom:
            self.number, self.y = self.number + 1, self.top
        at, self.y = self.y, self.y + height
        return at


def placed(paragraphs: list[dict], tables: list[list[list[str]]], page: Page | None = None) -> list[dict]:
    """Lines and cells with their places. Paragraphs have text, size, bold, italic and color (of their first run); tables follow the text."""
    page, out = page or Page(), []
    for p in paragraphs:
        text = p["text"].strip()
        if not text:
            page.y += BLANK
            continue
        size = p.get("size") or 11.0
        step = max(int(page.usable / (size * CHARACTER)), FEWEST)
        for at in range(0, len(text), step):
            y = page.room(size * LEADING)
            out.append({"page": page.number, "x": page.left, "y": y + size, "width": page.usable, "text": text[at : at + step], "size": size, "bold": bool(p.get("bold")), "italic": bool(p.get("italic")), "color": p.get("color") or "000000", "kind": "line"})
        page.y += AFTER
    for rows in tables:
        page.y += BEFORE_TABLE
        columns = max(map(len, rows), default=1) or 1
        width = page.usable / columns
        for row in rows:
            y = page.room(ROW)
            for k, cell in enumerate(row):
                out.append({"page": page.number, "x": page.left + k * width, "y": y, "width": width, "text": cell.strip()[: int(width / CELL_CHARACTER)], "size": CELL_SIZE, "bold": False, "italic": False, "color": "1A1A1A", "kind": "cell"})
    return out


def laid_out(documents: DataFrame) -> DataFrame:
    """documents (.., paragraphs, tables) exploded into the places of LAYOUT, one document at a time within its task."""

    def run(paragraphs: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([placed([dict(p) for p in ps] if ps is not None else [], [[list(r) for r in t] for t in ts] if ts is not None else []) for ps, ts in zip(paragraphs, tables)])

    keys = [c for c in documents.columns if c not in ("paragraphs", "tables")]
    return documents.select(*keys, F.inline(F.pandas_udf(run, f"array<struct<{LAYOUT}>>")("paragraphs", "tables")))
