"""Page rasters: change masks, regions, similarity and difference images, with numpy inside Arrow batches."""

from __future__ import annotations

import hashlib
import logging
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import GAP_X, GAP_Y, PAPER, SLACK

#: The comparison's thresholds and colours.
DPI, PAGES, DELTA, AREA = 144, 20, 25, 4
EDGE, BLEND, WINDOW = 35, 12, 7
#: Fewest even rows of a picture that are deflated apart.
EVEN = 8
MARK, ALPHA = (225, 35, 55), 240
REGIONS = "array<struct<id string, page int, x int, y int, width int, height int, diff_type string, severity string, pixel_count int, percentage double>>"
PAGE = (
    "pair_id long, page int, similarity double, confidence_score double, status string, diff_image_key string, original_image_key string, modified_image_key string, diff_only_image_key string, "
    f"regions {REGIONS}, page_size_name string, canvas_w int, canvas_h int, changed_pixels long, total_pixels long, changed_percentage double, images map<string, binary>"
)


def canvas(rgb: bytes | np.ndarray, w: int, h: int, to_w: int, to_h: int) -> np.ndarray:
    """A page at the top left of a white canvas, cut where it is larger."""
    out = np.full((to_h, to_w, 3), 255, np.uint8)
    page = (rgb if isinstance(rgb, np.ndarray) else np.frombuffer(rgb, np.uint8)).reshape(h, w, 3)[:to_h, :to_w]
    out[: page.shape[0], : page.shape[1]] = page
    return out


def _pixels(page: dict) -> tuple[np.ndarray, int, int]:
    """What is given of a page, and where (y, x) it begins: the whole page, or with ``at`` the box that holds its ink."""
    rgb, (y, x) = page["rgb"], page.get("at", (0, 0))
    return (rgb, y, x) if "at" in page else ((rgb if isinstance(rgb, np.ndarray) else np.frombuffer(rgb, np.uint8)).reshape(page["height_px"], page["width_px"], 3), y, x)


def inked(page: dict) -> tuple[int, int, int, int] | None:
    """The box (min_y, min_x, max_y, max_x; ends exclusive) of what is not white on a page; None if all is."""
    rgb, y, x = _pixels(page)
    if not rgb.size:
        return None
    flat = rgb.reshape(len(rgb), -1)
    rows = np.flatnonzero(flat.min(axis=1) < 255)
    if not len(rows):
        return None
    y0, y1 = int(rows[0]), int(rows[-1]) + 1
    columns = np.flatnonzero(flat[y0:y1].min(axis=0) < 255)
    return y + y0, x + int(columns[0]) // 3, y + y1, x + int(columns[-1]) // 3 + 1


def cut(page: dict, box: tuple[int, int, int, int]) -> np.ndarray:
    """A box of a page's canvas, white beyond what is given of the page."""
    y0, x0, y1, x1 = box
    rgb, y, x = _pixels(page)
    out = np.full((y1 - y0, x1 - x0, 3), 255, np.uint8)
    part = rgb[max(y0 - y, 0) : max(y1 - y, 0), max(x0 - x, 0) : max(x1 - x, 0)]
    if part.size:
        top, left = max(y - y0, 0), max(x - x0, 0)
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma in 16-bit fixed point (ITU-R 601 weights)."""
    r, g, b = (rgb[..., i].astype(np.int32) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.float32)


def _around(x: np.ndarray, pick) -> np.ndarray:
    p = np.pad(x, 1, mode="edge")
    rows = pick(pick(p[:-2], p[1:-1]), p[2:])
    return pick(pick(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])


def opened(mask: np.ndarray) -> np.ndarray:
    """What 2x2 squares within the mask cover."""
    out = np.zeros_like(mask)
    if min(mask.shape) < 2:
        return out
    full = mask[:-1, :-1] & mask[1:, :-1] & mask[:-1, 1:] & mask[1:, 1:]
    for dy in (0, 1):
        for dx in (0, 1):
            out[dy : dy + full.shape[0], dx : dx + full.shape[1]] |= full
    return out


def change_mask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels whose colour differs by more than DELTA, but for edges that are only smoothed otherwise, opened by 2x2."""
    delta = np.abs(a.astype(np.int16) - b.astype(np.int16)).max(axis=2) > DELTA
    ga, gb = gray(a), gray(b)
    la, ha, lb, hb = _around(ga, np.minimum), _around(ga, np.maximum), _around(gb, np.minimum), _around(gb, np.maximum)
    smooth = (ha - la > EDGE) & (hb - lb > EDGE) & (ga >= lb - BLEND) & (ga <= hb + BLEND) & (gb >= la - BLEND) & (gb <= ha + BLEND)
    return opened(delta & ~smooth)


def components(mask: np.ndarray, least: int = AREA) -> list[list[int]]:
    """[min_y, min_x, max_y, max_x, pixels] (ends exclusive) of 8-connected parts of at least ``least`` pixels, by runs of rows that hook onto the first run they touch until all of a part agree."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, start), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    if not len(y):
        return []
    wide = w + 2  # places of the row above lie before those of a row, with a gap
    first = np.searchsorted(y * wide + end, (y - 1) * wide + start, "left")
    n = np.maximum(np.searchsorted(y * wide + start, (y - 1) * wide + end, "right") - first, 0)
    below = np.repeat(np.arange(len(y)), n)
    above = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    root = np.arange(len(y))
    while len(below):
        p, q = root[below], root[above]
        apart = p != q
        if not apart.any():
            break
        below, above, p, q = below[apart], above[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    order = np.argsort(root, kind="stable")
    at = np.flatnonzero(np.diff(root[order], prepend=-1))
    of = lambda pick, x: pick.reduceat(x[order], at)
    boxes = np.stack([of(np.minimum, y), of(np.minimum, start), of(np.maximum, y) + 1, of(np.maximum, end), of(np.add, end - start)], axis=1)
    return boxes[boxes[:, 4] >= least].tolist()


def merged(boxes: list[list[int]], gap_x: int = GAP_X, gap_y: int = GAP_Y) -> list[list[int]]:
    """One pass from top left; see functions.geometry.merged_boxes for the same as a column expression."""
    clusters: list[list[int]] = []
    for y0, x0, y1, x1, n in sorted(boxes, key=lambda b: (b[0], b[1])):
        home = next((c for c in clusters if c[0] <= y1 + gap_y and y0 <= c[2] + gap_y and c[1] <= x1 + gap_x and x0 <= c[3] + gap_x), None)
        if home is None:
            clusters.append([y0, x0, y1, x1, n])
        else:
            home[:] = min(home[0], y0), min(home[1], x0), max(home[2], y1), max(home[3], x1), home[4] + n
    return clusters


def region(page: int, number: int, box: list[int], w: int, h: int) -> dict:
    y0, x0, y1, x1, n = box
    bw, bh = x1 - x0, y1 - y0
    if (bw > 100 and bh <= 8) or (bh > 100 and bw <= 8):
        kind = "table"
    elif bh <= 48:
        kind = "text" if bw >= 6 else "layout"
    else:
        kind = "image" if bw > 60 and n / max(bw * bh, 1) > 0.25 else "layout"
    severity = "high" if n > 400 or bw * bh > w * h * 0.05 else "medium" if n >= 70 else "low"
    return {"id": f"p{page}-r{number}", "page": page, "x": x0, "y": y0, "width": bw, "height": bh, "diff_type": kind, "severity": severity, "pixel_count": n, "percentage": round(n / (w * h) * 100, 3)}


def ssim(a: np.ndarray, b: np.ndarray, window: int = WINDOW, peak: float = 255.0) -> float:
    """Mean structural similarity over uniform windows with sample covariance (Wang et al., 2004); pages smaller than a window are compared as one window."""
    kind = np.int32 if a.dtype == b.dtype == np.int32 else np.float64  # sums of whole numbers are exact in both
    a, b = a.astype(kind), b.astype(kind)
    size = min(window, *a.shape)

    def mean(x):
        rows, columns = x.shape[0] - size + 1, x.shape[1] - size + 1
        s = x[:rows].copy()
        for k in range(1, size):
            s += x[k : k + rows]
        out = s[:, :columns].copy()
        for k in range(1, size):
            out += s[:, k : k + columns]
        return out / size**2

    n = size * size
    fix = n / (n - 1) if n > 1 else 1.0
    ma, mb = mean(a), mean(b)
    va, vb, cov = fix * (mean(a * a) - ma * ma), fix * (mean(b * b) - mb * mb), fix * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


@lru_cache(maxsize=256)
def _even_rows(n: int, width: int, ground: int) -> tuple[bytes, int, int]:
    """``n`` scan lines of ``width`` equal bytes, deflated by themselves, and their checksum and length."""
    data, deflate = (b"\0" + bytes([ground]) * width) * n, zlib.compressobj(6, zlib.DEFLATED, -15)
    return deflate.compress(data) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(data), len(data)


def _joined(a: int, b: int, size: int) -> int:
    """Adler-32 of two texts one after the other, from theirs and the size of the second."""
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % 65521
    high = ((a >> 16) + (b >> 16) + size * ((a & 0xFFFF) - 1)) % 65521
    return high << 16 | low


def png(pixels: np.ndarray, at: tuple[int, int] = (0, 0), shape: tuple[int, int] | None = None, ground: int = 255) -> bytes:
    """An 8-bit RGB or RGBA image as PNG: pixels at a place (y, x) of an even ground of a shape (by itself, the pixels alone). The bytes depend on the image and its ground only.

    Even rows are the most of many pages: runs of EVEN or more are deflated once, in powers of two.
    """
    channels = pixels.shape[2]
    h, w = shape or pixels.shape[:2]
    drawn = np.zeros(h + 2, bool)
    drawn[at[0] + 1 : at[0] + 1 + len(pixels)] = (pixels != ground).any(axis=(1, 2))
    edge = np.flatnonzero(np.diff(drawn))
    runs: list[list[int]] = []
    for y, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if runs and y - runs[-1][1] < EVEN:
            runs[-1][1] = end
        else:
            runs.append([y, end])
    even = lambda n: [_even_rows(1 << k, w * channels, ground) for k in range(n.bit_length()) if n >> k & 1]
    deflate, parts, upto = zlib.compressobj(6, zlib.DEFLATED, -15), [], 0
    for y, end in runs:
        lines = np.full((end - y, 1 + w * channels), ground, np.uint8)
        lines[:, 0] = 0
        lines[:, 1 + at[1] * channels : 1 + (at[1] + pixels.shape[1]) * channels] = pixels[y - at[0] : end - at[0]].reshape(end - y, pixels.shape[1] * channels)
        data = lines.tobytes()
        parts += [*even(y - upto), (deflate.compress(data) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(data), len(data))]
        upto = end
    parts += even(h - upto)
    check = 1
    for _, own, size in parts:
        check = _joined(check, own, size)
    data = b"\x78\x9c" + b"".join(p[0] for p in parts) + b"\x03\x00" + struct.pack(">I", check)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if channels == 4 else 2, 0, 0, 0)) + part(b"IDAT", data) + part(b"IEND", b"")


def image_key(data: bytes) -> str:
    """A key by content, of the form that files are served under."""
    d = hashlib.sha256(data).hexdigest()
    return f"diffs/{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}.png"


def size_name(w: float, h: float) -> str:
    short, long = min(w, h), max(w, h)
    name = next((n for n, a, b in PAPER if abs(short - a) <= SLACK and abs(long - b) <= SLACK), f"{round(w)}x{round(h)} pt")
    return f"{name} ({'Landscape' if w > h else 'Portrait'})"


def compare_page(page: int, o: dict | None, m: dict | None, assets: bool = True) -> dict:
    """The result for one page number; o and m have width_pt, height_pt, width_px, height_px and rgb (an array of the box at ``at`` only, if they have that), None where a side has no such page.

    Only the box that holds all ink of both pages is looked at, with a margin of a window: beyond it both are white, so that nothing differs and every window's similarity is exactly 1.
    """
    images: dict[str, bytes] = {}

    def store(pixels, *place):
        data = png(pixels, *place)
        key = image_key(data)
        images[key] = data
        return key

    out = {"page": page, "modified_image_key": None, "original_image_key": None, "diff_only_image_key": None, "regions": []}
    if o is None or m is None:
        one = o or m
        w, h = one["width_px"], one["height_px"]
        key = store(cut(one, (0, 0, h, w)))
        out |= {"status": "only_in_original" if m is None else "only_in_modified", "similarity": 0.0, "confidence_score": 0.0, "diff_image_key": key, "changed_pixels": w * h, "total_pixels": w * h, "changed_percentage": 100.0}
        out["original_image_key" if m is None else "modified_image_key"] = key
        size = one["width_pt"], one["height_pt"]
    else:
        size = max(o["width_pt"], m["width_pt"]), max(o["height_pt"], m["height_pt"])
        w, h = (int(round(x * DPI / 72.0)) for x in size)
        found = [box for s in (o, m) if (box := inked(s))] or [(0, 0, 1, 1)]
        y0, x0 = (max(min(min(box[k] for box in found), (h, w)[k] - 1) - WINDOW + 1, 0) for k in (0, 1))
        y1, x1 = (min(max(box[k + 2] for box in found) + WINDOW - 1, (h, w)[k]) for k in (0, 1))
        a, b = (cut(s, (y0, x0, y1, x1)) for s in (o, m))
        mask = change_mask(a, b)
        ga, gb = gray(a), gray(b)
        boxes = [[p + y0, q + x0, r + y0, s + x0, n] for p, q, r, s, n in components(mask)]
        out["regions"] = [region(page, k, box, w, h) for k, box in enumerate(merged(boxes), 1)]
        toned = lambda g: (g * 0.45 + 140).astype(np.uint8)
        heat = np.repeat(toned(ga)[..., None], 3, axis=2)
        heat[mask] = MARK
        place = (y0, x0), (h, w)
        out["diff_image_key"] = store(heat, *place, int(toned(np.float32(255))))
        if assets:
            only = np.zeros((*mask.shape, 4), np.uint8)
            only[mask] = (*MARK, ALPHA)
            out |= {"original_image_key": store(a, *place), "modified_image_key": store(b, *place), "diff_only_image_key": store(only, *place, 0)}
        changed, total = int(mask.sum()), w * h
        side = min(WINDOW, w, h)
        within, windows = ((p - side + 1) * (q - side + 1) for p, q in (mask.shape, (h, w)))
        alike = (ssim(ga.astype(np.int32), gb.astype(np.int32)) * within + (windows - within)) / windows
        similarity = round(min(1.0, max(0.0, 0.5 * alike + 0.5 * (1.0 - changed / total))), 4)
        out |= {"status": "compared", "similarity": similarity, "confidence_score": round(similarity * 100.0, 1), "changed_pixels": changed, "total_pixels": total, "changed_percentage": round(changed / total * 100, 4)}
    return out | {"page_size_name": size_name(*size), "canvas_w": w, "canvas_h": h, "images": images}


def paired_pages(original: DataFrame, modified: DataFrame, most: int = PAGES, extra: bool = True) -> DataFrame:
    """Pages (pair_id, page, ..) of both sides by number, up to ``most``; with ``extra`` pages of one side only, too."""
    side = lambda df, s: df.where(F.col("page") <= most).select("pair_id", "page", F.struct(*[c for c in df.columns if c not in ("pair_id", "page")]).alias(s))
    return side(original, "o").join(side(modified, "m"), ["pair_id", "page"], "full" if extra else "inner")


def compare_pages(original: DataFrame, modified: DataFrame, assets: bool = True, extra: bool = True, most: int = PAGES) -> DataFrame:
    """One row a page (schema PAGE) of rasters (pair_id, page, width_pt, height_pt, width_px, height_px, rgb); images holds the PNGs by key."""

    def run(batches):
        for b in batches:
            rows = []
            for pair, page, o, m in zip(b.pair_id, b.page, b.o, b.m):
                o, m = (None if not isinstance(x, dict) or x.get("rgb") is None else x | {k: int(x[k]) for k in ("width_px", "height_px")} for x in (o, m))
                if o is not None or m is not None:
                    rows.append({"pair_id": pair} | compare_page(int(page), o, m, assets))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _names()])

    return paired_pages(original, modified, most, extra).mapInPandas(run, PAGE)


def compare_documents(pairs: DataFrame, render, assets: bool = True, extra: bool = True, most: int = PAGES) -> DataFrame:
    """As compare_pages, with ``failed``, from both sides' files (pair_id, o_content, o_format, m_content, m_format): pages are drawn and compared within a task and never shuffled.

    ``render`` (content, format, most pages) gives pages one after the other. A pair whose pages cannot be drawn or compared gives one row that only says so.
    """
    names = _names()

    def run(batches):
        for b in batches:
            for pair, *files in zip(b.pair_id, b.o_content, b.o_format, b.m_content, b.m_format):
                rows = []
                try:
                    o, m = (iter(render(bytes(raw), kind, most)) for raw, kind in (files[:2], files[2:]))
                    for number in range(1, most + 1):
                        left, right = next(o, None), next(m, None)
                        if (left is None or right is None) if not extra else (left is None and right is None):
                            break
                        rows.append({"pair_id": pair, "failed": False} | compare_page(number, left, right, assets))
                except Exception:
                    logging.getLogger(__name__).warning("no pages of pair %s", pair, exc_info=True)
                    rows = [dict.fromkeys(names) | {"pair_id": pair, "failed": True}]
                out = pd.DataFrame(rows, columns=[*names, "failed"])
                yield out.astype({c: "Int64" for c in ("page", "canvas_w", "canvas_h", "changed_pixels", "total_pixels")})

    return pairs.mapInPandas(run, f"{PAGE}, failed boolean")


def _names() -> list[str]:
    return ["pair_id", "page", "similarity", "confidence_score", "status", "diff_image_key", "original_image_key", "modified_image_key", "diff_only_image_key", "regions", "page_size_name", "canvas_w", "canvas_h", "changed_pixels", "total_pixels", "changed_percentage", "images"]
