import csv
import io
import random
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from collatio.functions import geometry, labels
from collatio.operators import formatting, raster, tables
from collatio.plans.compare import compare_files, compare_texts, summarized
from collatio.sources import detect, parsers, storage
from collatio.streaming.files import arriving


def diff(a, b):
    return tables.diff_rows(a, b)


def kinds(rows):
    return {k: sum(r["type"] == k for r in rows) for k in tables.STATS}


def test_row_diff_cases():
    head, oak, elm = ["Tree", "Height"], ["Oak", "31"], ["Elm", "24"]
    base = [head, oak, elm]
    assert kinds(diff(base, base)) == {"equal": 3, "added": 0, "removed": 0, "modified": 0}
    assert kinds(diff(base[:2], base)) == {"equal": 2, "added": 1, "removed": 0, "modified": 0}
    assert kinds(diff(base, base[:2]))["removed"] == 1
    grown = diff(base[:2], [head, ["Oak", "33"]])
    assert kinds(grown)["modified"] == 1 and grown[1]["cell_changes"] == [{"row": 1, "col": 1, "original": "31", "modified": "33"}]
    assert [c["col"] for c in diff([oak], [["Oak", "old", "31"]])[0]["cell_changes"]] == [1, 2]
    assert kinds(diff([["a bench"]], [["three lamps"]])) == {"modified": 1, "added": 0, "removed": 0, "equal": 0}
    assert diff([], []) == []


def test_fast_rows_equal_alignment(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for t in range(40):
        o = [[str(rnd.randrange(40)), "x"] for _ in range(rnd.randrange(9))]
        m = [r for r in o if rnd.random() > 0.25]
        m = [[r[0], "y"] if rnd.random() < 0.2 else r for r in m]
        for _ in range(rnd.randrange(3)):
            m.insert(rnd.randrange(len(m) + 1), [f"new{rnd.randrange(50)}"])
        if rnd.random() < 0.2:
            rnd.shuffle(m)
        want[t] = [(r["type"], r["o_idx"], r["m_idx"], [tuple(c.values()) for c in r["cell_changes"]]) for r in diff(o, m)]
        rows += [(t, "o", i, r) for i, r in enumerate(o)] + [(t, "m", i, r) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "t int, side string, idx int, row array<string>")
    out, other = tables.fast_row_diff(df, ["t"])
    other = {r.t for r in other.collect()}
    got = {}
    for r in out.orderBy("t", "seq").collect():
        got.setdefault(r.t, []).append((r.type, r.o_idx, r.m_idx, [tuple(c) for c in r.cell_changes]))
    assert 0 < len(other) < 30
    every = {}
    for r in tables.any_row_diff(df, ["t"]).orderBy("t", "seq").collect():
        every.setdefault(r.t, []).append((r.type, r.o_idx, r.m_idx, [tuple(c) for c in r.cell_changes]))
    assert every == {t: w for t, w in want.items() if w}
    for t in set(want) - other:
        assert got.get(t, []) == want[t]


def test_tables_by_name(spark):
    schema = "pair_id long, table_pos int, name string, rows array<array<string>>"
    o = spark.createDataFrame([(1, 0, "Q1", [["a"]]), (1, 1, "Q2", [["b"]]), (1, 2, "Q1", [["z"]])], schema)
    m = spark.createDataFrame([(1, 0, "Q1", [["a"]]), (1, 1, "Q3", [["c"]])], schema)
    paired = tables.row_diff(tables.pair_tables(o, m)).collect()
    assert sorted((r.table_pos, r.name, r.rows[0].type) for r in paired) == [(0, "Q1", "modified"), (2, "Q1", "modified")]
    assert [r.name for r in tables.only_on_one_side(o, m).collect()] == ["Q2"] and [r.name for r in tables.only_on_one_side(m, o).collect()] == ["Q3"]


def test_formats(spark):
    schema = "pair_id long, side string, idx int, text string, font string, size double, bold boolean, italic boolean, underline boolean, color string"
    p = lambda pair, side, idx, text, font="Calibri", size=11.0, bold=False: (pair, side, idx, text, font, size, bold, False, False, None)
    rows = [p(1, "o", 0, "same"), p(1, "m", 0, "same"), p(2, "o", 0, "t"), p(2, "m", 0, "t", "Arial", 12.0, True), p(3, "o", 0, "minutes of the autumn meeting"), p(3, "m", 0, "seven brown hens"), p(4, "o", 0, "alone")]
    df = spark.createDataFrame(rows, schema)
    changes = formatting.compare_formats(df)
    stats = {r.pair_id: (r.unchanged, r.changed, r.added, r.removed) for r in formatting.format_stats(changes).collect()}
    assert stats == {1: (1, 0, 0, 0), 2: (0, 1, 0, 0), 3: (0, 0, 1, 1), 4: (0, 0, 0, 1)}
    assert [c.prop for c in changes.where("pair_id = 2").first().changed_properties] == ["font", "size", "bold"]


def test_dominant_takes_first_seen(spark):
    runs = spark.createDataFrame([(1, "o", 0, i, "x", f, 11.0, False, i == 2, False, None) for i, f in enumerate(["B", "A", "A", "B", None])], "pair_id long, side string, idx int, run_idx int, text string, font string, size double, bold boolean, italic boolean, underline boolean, color string")
    r = formatting.paragraph_formats(runs).first()
    assert (r.font, r.text, r.italic, r.bold) == ("B", "xxxxx", True, False)


def test_geometry(spark):
    df = spark.createDataFrame([(612.0, 792.0), (792.0, 612.0), (595.3, 841.9), (500.5, 500.5)], "w double, h double")
    assert [r.n for r in df.select(geometry.paper_size(F.col("w"), F.col("h")).alias("n")).collect()] == ["Letter (Portrait)", "Letter (Landscape)", "A4 (Portrait)", "500x500 pt (Portrait)"]
    rng = np.random.default_rng(1)
    boxes = [[(int(y), int(x), int(y + h), int(x + w), int(n)) for y, x, h, w, n in rng.integers(1, 60, (12, 5))] for _ in range(20)]
    df = spark.createDataFrame([(b,) for b in boxes], "boxes array<struct<min_y int, min_x int, max_y int, max_x int, n int>>").select("boxes", geometry.merged_boxes("boxes").alias("m"))
    for r in df.collect():
        assert [list(x) for x in r.m] == raster.merged([list(x) for x in r.boxes])
    b = spark.range(1).select(labels.page_colour(F.lit(0.985)).alias("a"), labels.page_confidence(F.lit(95.0)).alias("b"), labels.meter_band(F.lit(0.8999)).alias("c")).first()
    assert tuple(b) == ("match", "near identical", "high")


def page(fill=255, w=306, h=396):
    return {"width_pt": w / 2, "height_pt": h / 2, "width_px": w, "height_px": h, "rgb": np.full((h, w, 3), fill, np.uint8)}


def test_raster():
    a, b = page(), page()
    assert raster.compare_page(1, a, b, assets=False)["similarity"] == 1.0
    b["rgb"] = b["rgb"].copy()
    b["rgb"][50:60, 40:90] = 0
    r = raster.compare_page(3, a, b)
    assert len(r["images"]) == 4 and r["changed_pixels"] == 500 and r["regions"][0]["id"] == "p3-r1" and r["similarity"] < 1
    assert (r["regions"][0]["x"], r["regions"][0]["y"], r["regions"][0]["width"], r["regions"][0]["height"], r["regions"][0]["severity"]) == (40, 50, 50, 10, "high")
    assert raster.compare_page(2, a, None)["status"] == "only_in_original"
    data = raster.png(np.zeros((2, 3, 3), np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (3, 2) and zlib.decompress(data[41:-16])[:10] == bytes(10)
    assert storage.KEY and all(k.startswith("diffs/") for k in r["images"])


def test_components_by_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(30):
        mask = rng.random((12, 14)) < 0.4
        seen, want = set(), []
        for y, x in zip(*np.nonzero(mask)):
            if (y, x) not in seen:
                todo, part = [(y, x)], []
                seen.add((y, x))
                while todo:
                    p = todo.pop()
                    part.append(p)
                    for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= q[0] < 12 and 0 <= q[1] < 14 and mask[q] and q not in seen:
                            seen.add(q)
                            todo.append(q)
                ys, xs = zip(*part)
                want.append([min(ys), min(xs), max(ys) + 1, max(xs) + 1, len(part)])
        assert sorted(raster.components(mask, 1)) == sorted(want)


def test_pages_on_spark(spark):
    rows = [(1, p, 153.0, 198.0, 306, 396, bytes(page()["rgb"].tobytes())) for p in (1, 2, 25)]
    schema = "pair_id long, page int, width_pt double, height_pt double, width_px int, height_px int, rgb binary"
    got = raster.compare_pages(spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:1], schema)).orderBy("page").collect()
    assert [(r.page, r.status, r.similarity) for r in got] == [(1, "compared", 1.0), (2, "only_in_original", 0.0)]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("--", "."), data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs, table=""):
    body = "".join(f"<w:p>{''.join(f'<w:r><w:rPr>{prop}</w:rPr><w:t>{text}</w:t></w:r>' for text, prop in p)}</w:p>" for p in paragraphs)
    return zipped(**{"word__document--xml": f"<w:document {W}><w:body>{body}{table}</w:body></w:document>"})


def xlsx(rows):
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{c}</t></is></c>' if not c.startswith("=") else f'<c r="{chr(65 + j)}{i + 1}"><f>{c[1:]}</f><v>3</v></c>' for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    return zipped(**{"xl__workbook--xml": f'<workbook {rel}><sheets><sheet name="Sheet1" r:id="a"/></sheets></workbook>', "xl___rels__workbook--xml--rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>', "xl__worksheets__s--xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})


def pptx():
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    a = 'xmlns:a="http://a"'
    slide = f"<sld {a}><spTree><sp><txBody><a:p><a:r><a:t>Hello</a:t></a:r><a:r><a:t> deck</a:t></a:r></a:p><a:p/></txBody></sp><graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>k</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>v</a:t></a:r></a:p></a:tc></a:tr></a:tbl></graphicFrame></spTree></sld>"
    return zipped(**{"ppt__presentation--xml": f'<p {rel}><sldId r:id="x"/></p>', "ppt___rels__presentation--xml--rels": '<R><Relationship Id="x" Target="slides/s.xml"/></R>', "ppt__slides__s--xml": slide})


def test_parsers():
    assert parsers.docx_file(docx([("One", "")], [(" ", "")], [("Two", ""), (" words", "")], table="<w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"), "x") == "One\nTwo words\na | b"
    assert parsers.xlsx_file(xlsx([["h", "i"], ["=A1+B1", "7"]]), "x")[:2] == ("Sheet1: h | i\nSheet1: =A1+B1 | 7", [("Sheet1", [["h", "i"], ["=A1+B1", "7"]])])
    assert parsers.pptx_file(pptx(), "x") == ("Slide 1:\nHello deck\nk | v", [("Slide 1 table", [["k", "v"]])], [])
    assert parsers.csv_file(b'value\n007\n\n"a\nb",c\n', "x")[1] == [("csv", list(csv.reader(io.StringIO('value\n007\n\n"a\nb",c\n', newline=""))))]
    assert parsers.csv_file(b"", "x")[2]
    runs = parsers.docx_runs(docx([("a", '<w:rFonts w:ascii="Calibri"/><w:sz w:val="22"/><w:b/><w:color w:val="ff0000"/>'), ("b", '<w:i w:val="0"/>')]))
    assert (runs[0]["font"], runs[0]["size"], runs[0]["bold"], runs[0]["color"], runs[1]["italic"]) == ("Calibri", 11.0, True, "FF0000", False)


def test_detection(spark):
    rows = [("a.txt", b"x"), ("B.MD", b"x"), ("r.pdf", b"%PDF-1.7"), ("r.pdf", b"no"), ("d.docx", docx([("a", "")])), ("d.docx", b"PK"), ("s.xlsx", xlsx([["a"]])), ("p.pptx", pptx()), ("c.csv", b"a,b"), ("c.csv", b"\xff\xfe\x00"), ("n", b"x"), ("x.exe", b"x"), ("i.png", b"\x89PNG\r\n\x1a\nzz"), ("j.jpeg", b"\xff\xd8\xffz"), (None, b"")]
    df = spark.createDataFrame(rows, "f string, c binary").select(detect.detected(F.col("f"), F.col("c")).alias("d"))
    assert [r.d.format for r in df.collect()] == ["text", "text", "pdf", None, "docx", None, "xlsx", "pptx", "csv", None, None, None, "image", "image", None]
    assert all((r.d.format is None) == (r.d.error is not None) for r in df.collect())


def test_compare_files(spark):
    schema = "pair_id long, original_name string, original_content binary, modified_name string, modified_content binary"
    rows = [
        (1, "a.txt", b"One line.\nTwo lines here.", "b.txt", b"One line.\nTwo changed lines here."),
        (2, "a.csv", b"Tree,Height\nOak,31\n", "b.csv", b"Tree,Height\nOak,33\nElm,24\n"),
        (3, "a.docx", docx([("Title", '<w:rFonts w:ascii="Calibri"/>')]), "b.docx", docx([("Title", '<w:rFonts w:ascii="Arial"/>')])),
        (4, "a.pdf", b"no pdf", "b.txt", b"x"),
        (5, "a.csv", b"x,y\n", "b.txt", b"x | y"),
    ]
    res = compare_files(spark.createDataFrame(rows, schema)).cache()
    got = {r.pair_id: r for r in res.collect()}
    assert got[1].status == "done" and got[1].semantic_diff.stats.exact_match == 1 and got[1].table_diff is None and got[1].similarity < 1
    assert got[2].table_diff.tables[0].stats.modified == 1 and got[2].table_diff.tables[0].stats.added == 1
    assert got[3].formatting_diff.stats.changed == 1 and got[3].similarity == 1.0 and got[3].warnings == [] and [p.similarity for p in got[3].visual_diff] == [1.0]
    assert got[4].status == "failed" and "a.pdf" in got[4].error and got[4].similarity is None
    assert len(got[5].warnings) == 1 and got[5].semantic_diff.stats.exact_match == 1
    s = {r.pair_id: r for r in summarized(res).collect()}
    assert s[3].sentence == "These documents are 100% similar. We found 1 formatting change." and s[3].tabs == ["text", "formatting", "visual", "meaning"]
    assert s[5].sentence.endswith("no meaningful differences were found.") and s[1].content_tabs == ["text", "meaning"] and s[1].first_tab == "text"
    res.unpersist()


def test_compare_texts(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "x" * 100_001, "y"), (3, "", "Nothing stood here before.")], "pair_id long, original string, modified string")
    got = {r.pair_id: r for r in compare_texts(df).collect()}
    assert got[1].similarity == 1.0 and got[1].semantic_diff is None and got[2].status == "failed" and "original" in got[2].error and got[3].similarity == 0.0


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([("diffs/0a-1.png",), ("diffs/../x.png",), ("diffs/0g.png",), ("a/0.png",)], "k string")
    assert [r.s for r in df.select(storage.servable(F.col("k")).alias("s")).collect()] == [True, False, False, False]
    objects = spark.createDataFrame([(b"x",)], "content binary").withColumn("key", storage.diff_key(F.col("content"), "original"))
    storage.put_objects(objects, str(tmp_path / "o"))
    back = storage.get_objects(spark, str(tmp_path / "o"), objects).first()
    assert bytes(back.content) == b"x" and back.key.endswith("_original.png")
    cols = lambda rows: spark.createDataFrame(rows, "table_name string, column_name string")
    assert [tuple(r) for r in storage.missing_columns(cols([("t", "a"), ("t", "b"), ("new", "z")]), cols([("t", "a")])).collect()] == [("t", "b")]


def test_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    q = arriving(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").first().doc.text == "hello"
