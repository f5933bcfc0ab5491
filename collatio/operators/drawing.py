"""Pictures of pages without fonts: each character is a block pattern of its own, so that equal texts give equal pixels and changed ones differ.

This is the raster provider that is always there. A renderer with fonts may be registered in its place (``sources.parsers.PROVIDERS``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .layout import CHARACTER
from .raster import DPI

#: Rows and columns of a character's pattern.
GRID = (7, 5)


@lru_cache(maxsize=4096)
def pattern(char: str, bold: bool, italic: bool) -> np.ndarray:
    """Which fields of GRID a character fills: some half of them, none for blanks; bold letters fill their neighbours, italic ones lean."""
    if not char.strip():
        return np.zeros(GRID, bool)
    seed = char.encode("utf-8", "surrogatepass")
    bits = zlib.crc32(seed) | zlib.crc32(seed + b"+") << 32
    out = np.array([bits >> k & 1 for k in range(GRID[0] * GRID[1])], bool).reshape(GRID)
    out[0, 0] = out[-1, 0] = True
    if bold:
        out[:, 1:] |= out[:, :-1].copy()
    if italic:
        out[: GRID[0] // 2] = np.roll(out[: GRID[0] // 2], 1, axis=1)
    return out


def drawn(width: float, height: float, lines: list[dict], whole: bool = True) -> dict:
    """One page (width_pt, height_pt, width_px, height_px, rgb) from lines with x, y (the baseline, from the top), text, size, bold, italic and color (six hex digits), all in points.

    Unless it is wanted whole, rgb is only the box in which lines may leave ink, which begins at ``at`` (y, x).
    """
    zoom = DPI / 72.0
    w, h = max(1, round(width * zoom)), max(1, round(height * zoom))
    placed = []
    for line in lines:
        size = max(float(line["size"] or 11.0), 1.0)
        high, wide = max(GRID[0], int(size * 0.7 * zoom)), max(GRID[1], int(size * (CHARACTER - 0.08) * zoom))
        lefts = [int((line["x"] + k * size * CHARACTER) * zoom) for k in range(len(line["text"]))]
        placed.append((line, high, wide, int(line["y"] * zoom) - high, lefts))
    y0 = x0 = 0
    y1, x1 = h, w
    if not whole:
        some = [p for p in placed if p[4]]
        y0, x0 = (min(max(min(vs, default=0), 0), most) for vs, most in (([p[3] for p in some], h), ([min(p[4]) for p in some], w)))
        y1, x1 = (max(min(max(vs, default=0), most), least) for vs, most, least in (([p[3] + p[1] for p in some], h, y0), ([max(p[4]) + p[2] for p in some], w, x0)))
    rgb = np.full((y1 - y0, x1 - x0, 3), 255, np.uint8)
    for line, high, wide, top, lefts in placed:
        rows, columns = np.arange(high) * GRID[0] // high, np.arange(wide) * GRID[1] // wide
        color = np.array([int(line["color"][k : k + 2], 16) for k in (0, 2, 4)], np.uint8)
        for left, char in zip(lefts, line["text"]):
            if left >= w:
                break
            y, x = max(top, 0), max(left, 0)
            shape = pattern(char, bool(line["bold"]), bool(line["italic"]))[np.ix_(rows, columns)][y - top : max(h - top, 0), x - left : w - left]
            if shape.size:
                rgb[y - y0 : y - y0 + shape.shape[0], x - x0 : x - x0 + shape.shape[1]][shape] = color
    return {"width_pt": width, "height_pt": height, "width_px": w, "height_px": h, "rgb": rgb} | ({} if whole else {"at": (y0, x0)})


def pages(raw: bytes, kind: str, most: int) -> Iterator[dict]:
    """The first pages of a PDF, at its spans' places, or of a Word document, laid out by estimate."""
    from ..sources import parsers, pdf
    from .layout import placed

    if kind == "pdf":
        document = pdf.Document(raw)
        spans = document.spans()
        for number in range(1, min(len(document.pages), most) + 1):
            width, height, left, bottom = document.size(number)
            lines = [{"x": s.x - left, "y": height - (s.y - bottom), "text": s.text, "size": s.size, "bold": s.flags & pdf.BOLD, "italic": s.flags & pdf.ITALIC, "color": f"{s.color:06X}"} for s in spans if s.page == number]
            yield drawn(width, height, lines, whole=False)
    elif kind == "docx":
        page, paragraphs, tables = parsers.docx_layout(raw)
        lines = placed(paragraphs, tables, page)
        for number in range(1, min(page.number, most) + 1):
            yield drawn(page.width, page.height, [x for x in lines if x["page"] == number], whole=False)
    else:
        raise ValueError(f"no pages of {kind}")
