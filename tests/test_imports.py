"""Cases worked out by hand for doodles and imported designs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import doodles as D
from foliant.operators import imports as I
from foliant.sources import docx_styles

VOC = [(1, "crown", "crown"), (2, "owl", "bird"), (3, "raven", "bird"), (4, "iron crown", "helm"), (5, "sea", "waves"), (6, "owl", "other")]


@pytest.fixture(scope="module")
def voc(spark):
    return spark.createDataFrame(VOC, "ord int, word string, icon string")


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq int, type string, content string")


def put(df):
    return [tuple(r)[:6] for r in df.orderBy("doc_id", "seq", "place").collect()]


def test_words(spark, voc):
    own = blocks(spark, [(1, 0, "paragraph", "Crowned, the IRON CROWN; sea-owl seas"), (1, 1, "list", "crown"), (1, 2, "quote", ""), (1, 3, "heading", None)])
    got = D.candidates(own, voc, 4, shard_bytes=8).orderBy("at", "word").collect()
    assert [(r["at"], r["word"], r["icon"]) for r in got] == [(13, "iron crown", "helm"), (18, "crown", "crown"), (25, "sea", "waves"), (29, "owl", "bird")]


def test_densities(spark, voc):
    rows = [(1, k, "paragraph", "owl raven crown sea") for k in range(5)]
    assert D.doodles(blocks(spark, rows), voc, 0).count() == 0
    # one in a block, three blocks apart, never the icon before
    assert put(D.doodles(blocks(spark, rows), voc, 1)) == [(1, 0, 0, "owl", "bird", "left"), (1, 3, 0, "crown", "crown", "right")]
    # two in a block; the bird is not put down twice in a block nor twice in a row
    want = [(1, 0, 0, "owl", "bird", "left"), (1, 0, 1, "crown", "crown", "right"), (1, 1, 0, "owl", "bird", "left"), (1, 1, 1, "crown", "crown", "right")]
    assert put(D.doodles(blocks(spark, rows[:2]), voc)) == want
    assert [r[4] for r in put(D.doodles(blocks(spark, rows[:2]), voc, 4))] == ["bird", "crown", "waves"] * 2
    assert D.doodles(blocks(spark, rows), voc.where("false"), 4).count() == 0


def test_caps_over_a_long_document(spark, voc):
    rows = [(1, k, "quote", "owl" if k % 2 else "crown") for k in range(600)] + [(2, 0, "quote", "owl"), (None, 0, "quote", "sea")]
    got = D.doodles(blocks(spark, rows), voc, F.when(F.col("doc_id") == 1, 9).otherwise(1)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    assert {tuple(r) for r in got.collect()} == {(1, 250, 249), (2, 1, 0), (None, 1, 0)}


def test_draw(spark, voc):
    import zlib

    r = D.doodles(blocks(spark, [(1, 7, "paragraph", "the sea")]), voc).first()
    d = zlib.crc32(b"sea70")
    assert (r["size"], r["turn"], r["opacity"]) == (18 + d % 41, -22 + (d >> 8) % 45, (70 + (d >> 16) % 23) / 100)


def design(df, key="page_id"):
    return {r[key]: (r["properties"], {k: (v["fg"], v["bg"]) for k, v in r["elements"].items()}) for r in df.collect()}


def changed(props):
    return {k: v for k, v in props.items() if v != I.DEFAULTS[k]}


def test_pages(spark):
    rows = [
        (1, "<STYLE>html{color:#123} h1, h2 {color:#fff; border: 1px solid #C02020; color: #d03030}</STYLE><style>.warning{color:#FFFFFF;background:#B00}body{}</style>"),
        (2, "<p style='color:#222222'>a</p><!-- <p style='color:#999999'> --><p style='COLOR:#111;font-family:&quot;Lora&quot;,x'>b</p><h2 style=color:#777>c</h2><b style='color:#2040C0'>d</b>"),
        (3, '<div class="big-Callout x" style="color:#fff;background-color:#1A6E4A"></div><pre style="background:#eee"></pre><p data-style="color:#f00" title="a > b" style="color:red">'),
        (4, None),
        (5, "<p style=''>no colour</p>"),
    ]
    got = I.page_designs(spark.createDataFrame(rows, "page_id long, html string"))
    assert {r["page_id"]: r["origin"] for r in got.select("page_id", "origin").collect()} == {1: "rules", 2: "inline", 3: "inline", 4: "none", 5: "none"}
    d = design(got)
    assert changed(d[1][0]) == {"color_text": "#112233", "color_accent": "#D03030", "color_warning": "#BB0000"}
    assert d[1][1]["warning"] == ("#FFFFFF", "#BB0000") and d[1][1]["h1"] == ("#D03030", None) and d[1][1]["h2"] == (None, None)
    # grey headings vote for the text: three values with a vote each, the first stays
    assert changed(d[2][0]) == {"color_text": "#222222", "color_accent": "#2040C0", "font_body": "Lora", "font_heading": "Lora"}
    assert d[2][1]["h2"] == ("#777777", None) and d[2][1]["body"] == ("#222222", None)
    assert d[3][0]["color_callout"] == "#1A6E4A" and d[3][1]["callout"] == ("#FFFFFF", "#1A6E4A") and d[3][1]["code"] == (None, "#EEEEEE")
    assert d[3][0]["color_bg"] == "#1A6E4A" and d[3][0]["color_text"] == "#FFFFFF"
    assert changed(d[4][0]) == changed(d[5][0]) == {}


def docx(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml" if name != "theme" else "word/theme/theme1.xml", text)
    return bytearray(out.getvalue())


def test_docx(spark):
    w, a = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    run = lambda props, text="x": f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"
    red, gray, blue = ('<w:color w:val="%s"/>' % c for c in ("C02020", "777777", "2040c0"))
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{run(gray)}{run(blue)}</w:p><w:p>{run(red + "<w:b/>" + chr(60) + "w:sz w:val=" + chr(34) + "28" + chr(34) + "/>")}{run(red)}</w:p><w:p>{run(gray)}{run("<w:highlight w:val=" + chr(34) + "yellow" + chr(34) + "/>")}</w:p></w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:rPr><w:rFonts w:ascii="Cinzel"/><w:color w:val="00AA00"/></w:rPr></w:style><w:style w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:rFonts w:ascii="Georgia"/></w:rPr></w:style></w:styles>'
    theme = f'<a:theme {a}><a:clrScheme><a:dk1><a:sysClr lastClr="010203"/></a:dk1><a:lt1><a:srgbClr val="faf0e6"/></a:lt1><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme></a:theme>'
    empty = f"<w:document {w}><w:body/></w:document>"
    docs = spark.createDataFrame([(1, docx(document=body, styles=styles)), (2, docx(document=empty, styles=styles, theme=theme)), (3, docx(document=empty, theme=theme)), (4, bytearray(b"no zip")), (5, None)], "doc_id long, docx binary")
    d = design(I.run_designs(docx_styles.runs(docs), docx_styles.said(docs)), "doc_id")
    # red has two votes (its paragraph is large and bold), blue one, grey none among headings
    assert changed(d[1][0]) == {"color_accent": "#C02020", "color_text": "#777777", "font_heading": "Cinzel", "font_body": "Georgia"}
    assert d[1][1]["callout"] == (None, "#FFF3A0") and d[1][1]["h1"] == ("#C02020", None)
    assert changed(d[2][0]) == {"color_accent": "#00AA00", "color_text": "#010203", "color_bg": "#FAF0E6", "font_heading": "Cinzel", "font_body": "Georgia"}
    assert changed(d[3][0]) == {"color_accent": "#4472C4", "color_text": "#010203", "color_bg": "#FAF0E6"}
    assert changed(d[4][0]) == changed(d[5][0]) == {} and d[4][1]["h1"] == (None, None)


def test_runs_are_dealt_once_by_document(spark):
    runs = spark.createDataFrame([(1, p, k, "Heading 1" if p == 2 else None, None, None, c, f, "") for p, k, c, f in [(1, 0, "#222", "Lora"), (1, 1, "333333", "Lora"), (2, 0, "C02020", "Karla"), (2, 1, " c02020 ", None), (2, 2, "2040C0", "Inter"), (3, 0, "333", None)]], docx_styles.RUNS)
    got = I.run_designs(runs)
    # one exchange for the runs, one for the list of documents
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert changed(design(got, "doc_id")[1][0]) == {"color_accent": "#C02020", "color_text": "#333333", "font_heading": "Karla", "font_body": "Lora"}
    rows = {r["key"]: r["value"] for r in I.as_rows(got, "doc_id").collect()}
    assert rows["h1.fg"] == "#C02020" and "h1.bg" not in rows and rows["font_mono"] == "monospace"
