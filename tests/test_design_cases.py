"""Cases worked out by hand for designs, images, folios, aligned text and block templates."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import color as C
from foliant.functions import text as X
from foliant.operators import design as A
from foliant.operators import details as D
from foliant.operators import images as I
from foliant.operators import layout as Y
from foliant.operators import topics as T


def column(spark, values, fn):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x string").select("k", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


@pytest.mark.parametrize(
    ("fn", "values", "want"),
    [
        (X.density, ["3", " 9 ", "-4", "x", "", None, "1.5", "+1"], [3, 4, 0, 2, 2, 2, 2, 1]),
        (X.font_class, ["DM Mono", "Playfair Display", "Inter", "", None], ["mono", "serif", "sans", "sans", "sans"]),
        (X.normal_hex, ["abc", "#abc", " a1b2c3 ", "#ab", None], ["#AABBCC", "#AABBCC", "#A1B2C3", "#AB", None]),
        (X.pretty_label, ["a/b/c", "plain", "x/y + z", "", None], ["b/c (a)", "plain", "y (x) + z", "", None]),
        (X.without_private_marks, [" x", "ab", "", None], ["- x", "ab", "", None]),
        (I.alt_says_something, ["a map", "abc", "Image 12", "photo1.png", "  ", None, "IMG"], [True, False, False, False, False, False, False]),
        (I.is_data_uri, [" data:image/png;base64,AA==", "data:text/plain,x", "", None], [True, False, False, False]),
        (lambda x: I.from_data_uri(x)[1], ["data:image/jpeg;base64,AA==", "data:image/tiff;base64,AA==", "data:image/png;base64,", "x", None], [".jpeg", ".png", None, None, None]),
        (T.table_html, ["| a | <b> |\n|1|2|", "", "  \n "], ["<table>\n<thead><tr><th>a</th><th>&lt;b&gt;</th></tr></thead><tbody>\n<tr><td>1</td><td>2</td></tr>\n</tbody></table>", "", ""]),
        (lambda x: C.perceptual_shift(x.cast("double")), ["50", "160.5", "280", "0"], [-0.05, 0.0, 0.03, 0.0]),
    ],
)
def test_column(spark, fn, values, want):
    assert column(spark, values, fn) == want


def test_rounded_by_binary_value(spark):
    own = spark.createDataFrame([(0.25125,), (0.25126,), (-0.25125,), (0.5,), (None,)], "x double").select(C.rounded(F.col("x"), 4).alias("y")).collect()
    assert [r["y"] for r in own] == [0.2512, 0.2513, -0.2512, 0.5, None]


def test_data_uri_round_trip(spark):
    row = spark.createDataFrame([(bytearray(range(256)), ".JPG")], "b binary, e string")
    data, ending = I.from_data_uri(F.col("uri"))
    got = row.select("b", I.to_data_uri(F.col("b"), F.col("e")).alias("uri")).select("b", data.alias("d"), ending.alias("e")).first()
    assert got["b"] == got["d"] and got["e"] == ".jpeg"


def test_modifier(spark):
    rows = [("a", 350.0, 0.8, 0.1, "voyage", "warm", 15.0, 2.0, 0.1), ("b", 10.0, 0.5, 0.5, "neutral", "warm", 15.0, 2.0, 2.0), ("c", 10.0, 0.5, 0.5, "x/warm_tale", "warm", 15.0, 2.0, 2.0), ("d", 10.0, 0.5, 0.5, "voyage", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, hue double, sat double, energy double, genre string, modifier string, hue_shift double, sat_mult double, energy_mult double")
    got = {r["id"]: (r["hue"], r["sat"], r["energy"], r["modifier"]) for r in A.modified(df).collect()}
    assert got == {"a": (5.0, 0.85, 0.05, "warm"), "b": (10.0, 0.5, 0.5, None), "c": (10.0, 0.5, 0.5, None), "d": (10.0, 0.5, 0.5, None)}


def test_folios(spark):
    rows = [(1, 0, 0, 0.0, "7")]
    rows += [(1, 1, 0, 0.0, "a"), (1, 1, 1, 10.0, "b"), (1, 1, 2, 20.0, "c"), (1, 1, 3, 50.0, "8")]
    rows += [(1, 2, 0, 0.0, "a"), (1, 2, 1, 10.0, "b"), (1, 2, 2, 20.0, "9")]
    rows += [(1, 3, 0, 0.0, "words only")]
    got = Y.without_folios(spark.createDataFrame(rows, "doc_id int, page int, line int, top double, text string"))
    assert sorted((r["page"], r["text"]) for r in got.collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "9"), (2, "a"), (2, "b"), (3, "words only")]


def test_aligned_tables(spark):
    rows = spark.createDataFrame([(1, "a\tb\n\nc"), (2, "   "), (3, "x    y\r\nz  w"), (4, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["markdown"] for r in D.aligned_tables(rows).collect()}
    assert got == {1: "| a | b |\n| --- | --- |\n| c |  |", 2: "   ", 3: "| x | y |\n| --- | --- |\n| z  w |  |", 4: None}


def test_block_html(spark):
    rows = [(1, "task", 0, "do *it*", 80.0, None, None), (2, "image", 0, "a < b", 10.0, "x.png", None), (3, "image", 0, "", 10.0, None, None), (4, "odd", 0, "x", 50.0, None, None), (5, "heading", 9, "h", 0.0, None, None), (6, "list", 0, "a\n\n b ", 0.0, None, None)]
    got = {r["seq"]: r["html"] for r in T.block_html(spark.createDataFrame(rows, "seq int, type string, level int, content string, importance double, src string, caption string")).collect()}
    assert got[1] == '<div class="task-item importance-high"><label class="task-row "><input type="checkbox" disabled><span>do <em>it</em></span></label></div>'
    assert got[2] == '<figure class="figure"><img src="x.png" alt="a &lt; b" loading="lazy"></figure>'
    assert got[3] == "" and got[4] == '<p class="importance-med">x</p>' and got[5] == "<h6>h</h6>" and got[6] == "<ul><li>a</li><li>b</li></ul>"


def test_cells_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "\n".join(f"a{k}\tb" for k in range(2000)) + "\nx\ty\tz")], "doc_id int, text string")
    own = D.aligned_tables(rows)
    assert own.first()["markdown"].split("\n") == ["| a0 | b |  |", "| --- | --- | --- |"] + [f"| a{k} | b |  |" for k in range(1, 2000)] + ["| x | y | z |"]
    # once by lines, and once by tabs or by spaces
    assert own._jdf.queryExecution().optimizedPlan().toString().count("split(") == 3
