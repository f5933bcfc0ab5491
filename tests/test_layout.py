from collatio.operators.layout import Page, laid_out, placed


def test_lines_wrap_and_pages_turn():
    narrow = Page(width=244.0, height=100.0, top=10.0, bottom=10.0)
    out = placed([{"text": "x" * 40, "size": 10.0}, {"text": " "}, {"text": "y", "size": 20.0}], [], narrow)
    step = int(100 / 5.2)
    assert [len(r["text"]) for r in out[:3]] == [step, step, 40 - 2 * step] and [r["y"] for r in out[:3]] == [20.0, 33.5, 47.0]
    assert out[3]["page"] == 1 + (10 + 3 * 13.5 + 4 + 12 + 27 > 90) and out[3]["size"] == 20.0
    many = placed([{"text": "line"}] * 60, [])
    assert many[-1]["page"] == 2 and max(r["y"] for r in many) <= 720 + 11


def test_tables_follow_text(spark):
    df = spark.createDataFrame([(1, [("Title", 14.0, True)], [[["a", "b"], ["c" * 99, ""]]]), (2, [], [])], "id long, paragraphs array<struct<text string, size double, bold boolean>>, tables array<array<array<string>>>")
    got = laid_out(df).collect()
    assert [r.kind for r in got] == ["line"] + ["cell"] * 4 and got[0].bold and got[2].x == 72 + 234 and got[3].y == got[1].y + 20 and len(got[3].text) == 39
