"""Files of all kinds end to end: PDF text and spans, pages, damaged files, layers that break off, dates and formulas."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatio.functions import geometry
from collatio.operators import drawing, raster
from collatio.plans.compare import NO_FORMATS, NO_PAGES, ONE_SIDED_FORMATS, compare_files, compare_texts, summarized
from collatio.sources import parsers, pdf, storage
from test_layers import docx, xlsx, zipped

PAIRS = "pair_id long, original_name string, original_content binary, modified_name string, modified_content binary"


def built(pages, fonts=("/Subtype/Type1/BaseFont/Helvetica",), more=(), pack=True, packed_objects=False):
    """A PDF of content streams; fonts are F1, F2 and so on, objects in ``more`` come after them."""
    n = 2 + 2 * len(pages)
    resources = "<</Font<<" + "".join(f"/F{i} {n + i} 0 R" for i in range(1, len(fonts) + 1)) + ">>>>"
    plain = [b"<</Type/Catalog/Pages 2 0 R>>", ("<</Type/Pages/MediaBox[0 0 612 792]/Resources" + resources + "/Kids[" + " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages))) + f"]/Count {len(pages)}>>").encode()]
    streams = {}
    for i, content in enumerate(pages):
        plain += [f"<</Type/Page/Parent 2 0 R/Contents {4 + 2 * i} 0 R>>".encode(), None]
        data = zlib.compress(content) if pack else content
        streams[4 + 2 * i] = b"<<%s/Length %d>>\nstream\n%s\nendstream" % (b"/Filter/FlateDecode" if pack else b"", len(data), data)
    plain += [b"<</Type/Font" + f.encode() + b">>" for f in fonts] + list(more)
    out = b"%PDF-1.5\n"
    if packed_objects:
        body, places = b"", ""
        for number, x in enumerate(plain, 1):
            if x is not None and b"stream" not in x:
                places += f"{number} {len(body)} "
                body += x + b" "
        data = zlib.compress(places.encode() + body)
        out += b"99 0 obj\n<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(places.split()) // 2, len(places), len(data), data)
    for number, x in enumerate(plain, 1):
        x = streams.get(number, x)
        if not packed_objects or b"stream" in x:
            out += b"%d 0 obj\n%s\nendobj\n" % (number, x)
    return out + b"trailer\n<</Root 1 0 R>>\n%%EOF\n"


def shown(*lines, size=12, font="F1", gap=16):
    return b"BT /%s %g Tf 72 700 Td %g TL " % (font.encode(), size, gap) + b" T* ".join(b"(" + x.encode("latin-1").replace(b"(", b"\\(") + b") Tj" for x in lines) + b" ET"


def test_pdf_text_of_ordinary_producers():
    two = [shown("First line of the page", "and (the second"), b"BT /F1 12 Tf 1 0 0 1 72 700 Tm [(wor) -20 (ld) -400 (apart)] TJ 0 -20 Td <48656C6C6F> Tj (\\101\\n) ' ET"]
    for raw in (built(two), built(two, pack=False), built(two, packed_objects=True), built(two).replace(b"/Length", b"/Longth")):
        assert pdf.Document(raw).texts() == ["First line of the page\nand (the second", "world apart\nHello\nA"]
    cmap = b"<</Length 99>>\nstream\n2 beginbfchar <0001> <0047> <0002> <00E9> endbfchar 1 beginbfrange <0003> <0005> <0061> endbfrange 1 beginbfrange <0006> <0007> [<0078> <D83DDE00>] endbfrange\nendstream"
    wide = built([b"BT /F1 9 Tf 10 10 Td <000100020003000400050006000700FF> Tj ET"], ["/Subtype/Type0/BaseFont/ABCDEF+Some/ToUnicode 6 0 R/DescendantFonts[<<>>]"], [cmap])
    assert pdf.Document(wide).texts() == ["Géabcx\U0001f600"]
    named = built([b"BT /F1 9 Tf 10 10 Td (\x01\x02\x03z) Tj ET"], ["/Subtype/Type1/BaseFont/X/Encoding<</Differences[1/Adieresis/fi/uni20AC]>>"])
    assert pdf.Document(named).texts() == ["Äfi€z"]
    form = built([b"q 1 0 0 1 50 50 cm /X1 Do Q"], more=[b"<</Type/XObject/Subtype/Form/Length 40>>\nstream\n" + shown("inside a form") + b"\nendstream"]).replace(b"/Resources<</Font", b"/Resources<</XObject<</X1 6 0 R>>/Font")
    assert pdf.Document(form).texts() == ["inside a form"]


def test_pdf_spans():
    content = b"BT /F1 12 Tf 1 0 0 rg 72 700 Td (Title) Tj /F2 10.25 Tf 0 g 0 -40 Td (body ) Tj 0 0 1 rg (blue) Tj 0 -12 Td (next line) Tj ET"
    raw = built([content, shown("second page")], ["/Subtype/Type1/BaseFont/Times-BoldItalic", "/Subtype/TrueType/BaseFont/ABCDEF+Arial"])
    rows = parsers.pdf_spans(raw)
    assert [(r["idx"], r["text"], r["font"], r["size"], r["flags"], r["color"]) for r in rows] == [
        (0, "Title", "Times-BoldItalic", 12.0, pdf.BOLD | pdf.ITALIC, 0xFF0000), (1, "body ", "Arial", 10.25, 0, 0), (1, "blue", "Arial", 10.25, 0, 0xFF), (1, "next line", "Arial", 10.25, 0, 0xFF), (2, "second page", "Times-BoldItalic", 12.0, 18, 0),
    ]
    assert pdf.Document(raw).size(1) == (612, 792, 0, 0)


DAMAGED = [
    ("a.pdf", b"%PDF-1.7 no objects at all"), ("a.pdf", b"%PDF-1.4\n1 0 obj <</Type/Catalog>> endobj trailer <</Root 1 0 R>>"), ("a.pdf", built([shown("x")]).replace(b"trailer\n<<", b"trailer\n<</Encrypt 9 0 R")),
    ("a.pdf", built([b"damaged!"], pack=False).replace(b"<</Length 8>>", b"<</Filter/FlateDecode/Length 8>>")), ("a.png", b"\x89PNG\r\n\x1a\nzz"), ("a.png", raster.png(np.zeros((9, 9, 3), np.uint8))[:-20]), ("a.jpg", b"\xff\xd8\xff\xe0\x00\x04ab"),
    ("a.docx", docx([("some words", "")])[:-60] + b"x" * 60), ("a.docx", zipped(**{"word__document--xml": "<w:document>"})), ("a.xlsx", zipped(**{"xl__workbook--xml": "<workbook/>"})), ("a.pptx", zipped(**{"ppt__presentation--xml": "<p"})),
    ("a.xlsx", xlsx([["a"]]).replace(b"inlineStr", b"s        ")), ("a.csv", b"\xff,x"), ("a.exe", b"x"), (None, b"x"), ("a.txt", None),
]


def _broken_parts():
    """Office files whose archives hold bytes that do not inflate, or cells that point nowhere."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:document/>" * 500)
    raw = bytearray(out.getvalue())
    raw[60:70] = b"\xff" * 10
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = zipped(**{"xl__workbook--xml": f'<workbook {rel}><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl___rels__workbook--xml--rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>', "xl__worksheets__s--xml": '<worksheet><row><c r="A1" t="s"><v>7</v></c></row></worksheet>'})
    return [("a.docx", bytes(raw)), ("a.xlsx", cells)]


def test_damaged_files_are_errors_of_their_own(spark):
    good = [("b.txt", b"fine"), ("b.csv", b"a," + b"y" * 200_000), ("b.pdf", built([shown("A text layer of some length")])), ("b.png", raster.png(np.zeros((9, 9, 3), np.uint8))), ("b.jpg", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04ab\xff\xda\x00\x04abdata\xff\xd9")]
    rows = [(i, n, c) for i, (n, c) in enumerate(DAMAGED + _broken_parts() + good)]
    got = {r.i: r.doc for r in parsers.extracted(spark.createDataFrame(rows, "i int, filename string, content binary")).collect()}
    bad = len(rows) - len(good)
    for i, name, _ in rows:
        assert (got[i].error is not None) == (i < bad), (name, got[i])
        assert i >= bad or name is None or name in got[i].error
    assert got[bad + 1].tables[0].rows == [["a", "y" * 200_000]] and got[bad + 2].text == "A text layer of some length"


def test_files_with_pages_and_styles_end_to_end(spark, tmp_path):
    word = lambda *x: docx(*[[(t, '<w:rFonts w:ascii="Helvetica"/><w:sz w:val="24"/>')] for t in x])
    lines = ["A paragraph that is the same on both sides", "Another one that will change a little"]
    a, b = built([shown(*lines, gap=40)]), built([shown(lines[0], lines[1] + " today", gap=40), shown("One more page")])
    bold = built([shown(*lines, gap=40)], ["/Subtype/Type1/BaseFont/Helvetica-Bold"])
    odd = zipped(**{"word__document--xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:rPr><w:sz w:val="huge"/></w:rPr><w:t>Some text here</w:t></w:r></w:p></w:body></w:document>'})
    rows = [(1, "a.pdf", a, "b.pdf", b), (2, "a.pdf", a, "b.docx", word(*lines)), (3, "a.pdf", a, "b.pdf", bold), (4, "a.pdf", a, "b.txt", b"x"), (5, "a.docx", odd, "b.docx", word("Some text here")), (6, "a.docx", word(lines[0]), "b.docx", word(lines[0]))]
    out = compare_files(spark.createDataFrame(rows, PAIRS), images=str(tmp_path / "images")).cache()
    got = {r.pair_id: r for r in out.collect()}
    assert [r.status for r in got.values()] == ["done"] * 6
    kinds = {i: {k: v for k, v in r.formatting_diff.stats.asDict().items() if v} for i, r in got.items() if r.formatting_diff}
    assert kinds == {1: {"unchanged": 2, "added": 1}, 2: {"changed": 2}, 3: {"changed": 2}, 6: {"unchanged": 1}}
    assert got[3].formatting_diff.changes[0].changed_properties[0].asDict() == {"prop": "font", "from_value": "Helvetica", "to_value": "Helvetica-Bold"}
    assert {(c.prop, c.from_value, c.to_value) for x in got[2].formatting_diff.changes for c in x.changed_properties} == {("color", "000000", None)}
    assert [(p.page, p.status) for p in got[1].visual_diff] == [(1, "compared"), (2, "only_in_modified")] and got[1].visual_diff[0].regions and 0.9 < got[1].visual_diff[0].similarity < 1
    assert got[6].visual_diff[0].similarity == 1.0 and not got[6].visual_diff[0].regions and got[4].visual_diff is None and got[4].warnings == [ONE_SIDED_FORMATS]
    assert got[5].formatting_diff is None and got[5].visual_diff is None and got[5].warnings == [NO_PAGES, NO_FORMATS] and got[5].semantic_diff.stats.exact_match == 1
    stored = {r.key: bytes(r.content) for r in storage.get_objects(spark, str(tmp_path / "images")).collect()}
    named = {k for r in got.values() for p in r.visual_diff or () for k in (p.diff_image_key, p.original_image_key, p.modified_image_key, p.diff_only_image_key) if k}
    assert named == set(stored) and all(raster.image_key(v) == k and v[:4] == b"\x89PNG" for k, v in stored.items())
    totals = {r.pair_id: r for r in summarized(out).collect()}
    assert totals[1].n_regions == sum(len(p.regions) for p in got[1].visual_diff) > 0 and totals[6].n_regions == 0 and totals[1].n_visible_matches == 3
    storage.write_results(out, str(tmp_path / "results"), "first")
    assert spark.read.parquet(str(tmp_path / "results")).where("run = 'first' AND status = 'done'").count() == 6
    out.unpersist()


def test_registered_providers_reach_the_tasks(spark, monkeypatch):
    monkeypatch.setitem(parsers.PROVIDERS, "ocr", lambda raw, most: f"read by eye, at most {most} pages")
    monkeypatch.setitem(parsers.PROVIDERS, "raster", lambda raw, kind, most: iter([{"width_pt": 4.0, "height_pt": 4.0, "width_px": 8, "height_px": 8, "rgb": bytes([len(raw) % 256] * 192)}]))
    scan = built([b"q Q"] * 21)
    rows = [(1, "a.pdf", scan, "b.pdf", scan), (2, "a.png", raster.png(np.zeros((2, 2, 3), np.uint8)), "b.txt", b"read by eye")]
    got = {r.pair_id: r for r in compare_files(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got[1].similarity == 1.0 and any("first 20 of the 21 pages" in w for w in got[1].warnings) and got[1].visual_diff[0].similarity == 1.0 and len(got[1].visual_diff) == 1
    assert got[2].similarity > 0.4 and any("OCR" in w for w in got[2].warnings)


def test_pages_that_cannot_be_drawn_fail_alone(spark):
    rows = [(1, b"no pdf", "pdf", b"no pdf", "pdf"), (2, built([shown("x")] * 25), "pdf", built([shown("x")] * 3), "pdf")]
    got = raster.compare_documents(spark.createDataFrame(rows, "pair_id long, o_content binary, o_format string, m_content binary, m_format string"), drawing.pages).orderBy("pair_id", "page").collect()
    assert got[0].failed and got[0].page is None and [r.page for r in got[1:]] == list(range(1, 21)) and [r.status for r in got[3:5]] == ["compared", "only_in_original"]


def test_drawn_pages_follow_their_text():
    line = {"x": 10.0, "y": 30.0, "text": "Words", "size": 12.0, "bold": False, "italic": False, "color": "FF0000"}
    a, again, other = (drawing.drawn(100.0, 50.0, [line | {"text": t}]) for t in ("Words", "Words", "Wards"))
    assert a["rgb"].shape == (100, 200, 3) and (a["rgb"] == again["rgb"]).all() and (a["rgb"] != other["rgb"]).any() and {tuple(p) for p in a["rgb"].reshape(-1, 3)} == {(255, 255, 255), (255, 0, 0)}
    out = drawing.drawn(20.0, 10.0, [line | {"x": -5.0, "y": 4.0, "text": "x" * 90}, line | {"y": 500.0}])
    assert out["rgb"].shape == (20, 40, 3)


def test_spreadsheet_dates_and_shared_formulas():
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = '<worksheet><row r="1"><c r="A1" s="1"><v>45000</v></c><c r="B1" s="1"><v>45000.75</v></c><c r="C1" s="2"><v>0.5</v></c><c r="D1" s="0"><v>45000</v></c><c r="E1" s="3"><v>1.5</v></c></row>'
    sheet += '<row r="2"><c r="A2"><f t="shared" ref="A2:B3" si="0">SUM(A1:$B1)+A$1*LOG10(2)&amp;"A1"</f><v>1</v></c><c r="B2"><f t="shared" si="0"/><v>2</v></c></row><row r="3"><c r="A3"><f t="shared" si="0"/></c><c r="B3" t="b"><v>1</v></c></row></worksheet>'
    styles = '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    raw = zipped(**{"xl__workbook--xml": f'<workbook {rel}><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl___rels__workbook--xml--rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>', "xl__worksheets__s--xml": sheet, "xl__styles--xml": styles})
    rows = parsers.xlsx_file(raw, "x")[1][0][1]
    assert rows[0] == ["2023-03-15 00:00:00", "2023-03-15 18:00:00", "12:00:00", "45000", "1.5"]
    assert [r[0] for r in rows[1:]] == ['=SUM(A1:$B1)+A$1*LOG10(2)&"A1"', '=SUM(A2:$B2)+A$1*LOG10(2)&"A1"'] and rows[1][1] == '=SUM(B1:$B1)+B$1*LOG10(2)&"A1"' and rows[2][1] == "True"


def test_regions_and_page_names_agree_with_their_columns(spark):
    rng = np.random.default_rng(3)
    boxes = [(int(y), int(x), int(y + h), int(x + w), int(n)) for y, x, h, w, n in zip(rng.integers(0, 50, 300), rng.integers(0, 50, 300), rng.integers(1, 120, 300), rng.integers(1, 160, 300), rng.integers(1, 6000, 300))]
    df = spark.createDataFrame([(*b, 500 + b[0], 700 + 3.5 * b[1]) for b in boxes] + [(0, 0, 1, 1, 1, 612, 792.0)], "y0 int, x0 int, y1 int, x1 int, n int, pw int, ph double")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    for r in df.select("*", geometry.region_type(w, h, F.col("n")).alias("kind"), geometry.region_severity(w, h, F.col("n"), F.lit(1224), F.lit(1584)).alias("severity"), geometry.paper_size(F.col("pw").cast("double"), F.col("ph")).alias("paper")).collect():
        plain = raster.region(1, 1, [r.y0, r.x0, r.y1, r.x1, r.n], 1224, 1584)
        assert (plain["diff_type"], plain["severity"]) == (r.kind, r.severity) and raster.size_name(float(r.pw), r.ph) == r.paper


@pytest.mark.parametrize("text", ["x" * 100_001, None])
def test_limits_and_nulls(spark, text):
    got = compare_texts(spark.createDataFrame([(1, text, "y")], "pair_id long, original string, modified string")).first()
    assert (got.status == "failed") == (text is not None) and (text is not None or got.similarity == 0.0)




def test_plain_texts_have_the_columns_of_files(spark):
    texts = compare_texts(spark.createDataFrame([(1, "a", "b")], "pair_id long, original string, modified string"))
    files = compare_files(spark.createDataFrame([(1, "a.pdf", built([shown("some words in a file")]), "b.pdf", built([shown("other words in a file")]))], PAIRS))
    assert [(f.name, f.dataType.simpleString()) for f in texts.schema] == [(f.name, f.dataType.simpleString()) for f in files.schema]
