import zlib

import numpy as np

from collatio.operators import drawing, raster


def pixels(data: bytes) -> tuple[bytes, bytes]:
    """The header and the scan lines of a PNG."""
    at, found = 8, {}
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
    return found[b"IHDR"], zlib.decompress(found[b"IDAT"])


def lines(*texts):
    return [{"x": 30.0, "y": 40.0 + 60 * k, "text": t, "size": 11.0, "bold": False, "italic": False, "color": "204060"} for k, t in enumerate(texts)]


def test_only_the_box_with_ink_is_looked_at(monkeypatch):
    seen = []
    monkeypatch.setattr(raster, "change_mask", lambda a, b, f=raster.change_mask: seen.append(a.shape) or f(a, b))
    o, m = (drawing.drawn(612.0, 792.0, lines("some words", t), whole=False) for t in ("of a page", "on a page"))
    got = raster.compare_page(1, o, m)
    assert seen[0][0] * seen[0][1] < 1224 * 1584 / 20 and (got["canvas_w"], got["canvas_h"], got["total_pixels"]) == (1224, 1584, 1224 * 1584)

    a, b = (drawing.drawn(612.0, 792.0, lines("some words", t)) for t in ("of a page", "on a page"))
    assert raster.compare_page(1, a, b) == got and raster.compare_page(1, o, None) == raster.compare_page(1, a, None)
    whole = {"mask": raster.change_mask(a["rgb"], b["rgb"]), "gray": raster.gray(a["rgb"])}
    assert got["changed_pixels"] == whole["mask"].sum() > 0
    assert got["regions"] == [raster.region(1, k, box, 1224, 1584) for k, box in enumerate(raster.merged(raster.components(whole["mask"])), 1)]
    alike = raster.ssim(whole["gray"], raster.gray(b["rgb"]))
    assert got["similarity"] == round(0.5 * alike + 0.5 * (1 - whole["mask"].sum() / whole["mask"].size), 4)
    heat = np.repeat((whole["gray"] * 0.45 + 140).astype(np.uint8)[..., None], 3, axis=2)
    heat[whole["mask"]] = raster.MARK
    for key, want in (("original_image_key", a["rgb"]), ("modified_image_key", b["rgb"]), ("diff_image_key", heat)):
        assert pixels(got["images"][got[key]]) == pixels(raster.png(want))
        assert pixels(raster.png(want))[1] == b"".join(b"\0" + row.tobytes() for row in want)


def test_pages_without_ink_and_of_other_sizes():
    blank, small = drawing.drawn(100.0, 50.0, [], whole=False), drawing.drawn(2.0, 2.0, lines("x"))
    got = raster.compare_page(1, blank, small)
    assert (got["similarity"], got["changed_pixels"], got["canvas_w"], got["canvas_h"]) == (1.0, 0, 200, 100)
    dark = {"width_pt": 2.0, "height_pt": 2.0, "width_px": 4, "height_px": 4, "rgb": bytes(48)}
    assert raster.compare_page(1, blank, dark)["changed_pixels"] == 16 and raster.compare_page(1, dark, dark)["similarity"] == 1.0
