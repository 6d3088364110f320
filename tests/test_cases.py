"""Cases worked out by hand, for rules that the synthesised tables do not reach."""

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import title_case
from foliant.operators import details as D
from foliant.operators import layout as Y
from foliant.operators import lexicon as X
from foliant.operators import lines as L
from foliant.sources import files


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>foo<b>bar</b>.</p>", "foo bar ."),
        ("<p>a <img src='https://x/y.png' alt='z'></p>", "a"),
        ("<p><img src=' https://x/y.png ' alt=' z '></p>", "![z](https://x/y.png)"),
        ("<ul><li>one <i>two</i></li><li>three</li><p>lost</p></ul>", "- one two\n\n- three"),
        ("<ol><li>one<ul><li>deep</li></ul></li></ol>", "- one deep"),
        ("<pre>  x\n  y</pre>", "```\nx\n  y\n```"),
        ("<figure><img src='https://x/y.png'><figcaption>Cap <b>on</b></figcaption></figure>", "![](https://x/y.png)\n*Cap on*"),
        ("<figure><img src='local.png'><figcaption>Cap</figcaption></figure>", ""),
        ("<figure><p>words</p><figcaption>Cap</figcaption></figure>", "words\n\n*Cap*"),
        ("<figure><a><img src='data:x'></a></figure>", "![](data:x)"),
        ("<blockquote> </blockquote><hr><span>lost</span>loose<table><tr><td>lost</td></tr></table>", "---"),
        ("<header>t<h1>Top</h1></header><nav><p>n</p></nav><footer><p>f</p></footer>", "# Top"),
        ("", ""),
    ],
)
def test_html_markdown(source, want):
    assert files.html_markdown(source) == want


def test_title_case(spark):
    cases = ["THE-END PART", "it's o'clock", "ÉTUDE 3RD", "", "a1b2", "don't STOP"]
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select("x", title_case(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == {x: x.title() for x in cases}


def test_capitals_become_titles(spark):
    docs = spark.createDataFrame([(1, "CAST\n\nIron: A metal that suppresses magic")], "doc_id long, text string")
    got = D.raw_markdown(L.classify_raw(L.split_lines(docs)))
    assert [r["markdown"] for r in got.orderBy("line_no").collect()][0] == "# Cast"


def positioned(spark, words):
    return spark.createDataFrame([(1, 0, k, t, float(x), float(x + 40), float(top), 10.0) for k, (t, x, top) in enumerate(words)], "doc_id long, page int, word_seq int, text string, x0 double, x1 double, top double, size double")


def test_lines_do_not_drift(spark):
    words = positioned(spark, [("a", 10, 100), ("b", 60, 102), ("c", 110, 104), ("d", 160, 106), ("e", 10, 103), ("f", 60, 107.5)])
    got = [(r["line"], r["text"]) for r in Y.visual_lines(words).orderBy("line").collect()]
    assert got == [(0, "a e b"), (1, "c d"), (2, "f")]


def fold(rows, tolerance=3.0):
    """Lines by reading words from the top; a line is anchored on its first word."""
    lines, anchor = [], None
    for r in sorted(rows, key=lambda r: (r["top"], r["x0"])):
        if anchor is None or r["top"] - anchor > tolerance:
            lines.append([])
            anchor = r["top"]
        lines[-1].append(r)
    return [(k, " ".join(r["text"] for r in sorted(line, key=lambda r: (r["x0"], r["word_seq"])))) for k, line in enumerate(lines)]


def test_lines_match_a_fold(spark):
    import random

    own = random.Random(4)
    words = positioned(spark, [(f"w{k}", own.randrange(0, 500), own.randrange(0, 400) / 4) for k in range(300)])
    assert [(r["line"], r["text"]) for r in Y.visual_lines(words).orderBy("line").collect()] == fold(words.collect())


def test_margin_of_clusters(spark):
    edges = [50] * 5 + [52] * 4 + [54] * 8 + [90] * 2 + [120]  # 50 and 52 are one edge, 54 the next
    rows = [(1, 0, k, "x", float(x), float(k)) for k, x in enumerate(edges)] + [(2, 0, 0, "x", 33.4, 1.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, text string, x0 double, top double")
    assert {r["doc_id"]: r["margin"] for r in Y.left_margin(lines).collect()} == {1: 50.0, 2: 33.0}


def test_gutter_between_columns(spark):
    words = [(f"w{k}", x, 12 * k) for k in range(30) for x in (10, 60, 110, 260, 310, 360)]
    assert [tuple(r) for r in Y.gutter(positioned(spark, words)).collect()] == [(1, 0, 76, 129)]


def test_large_lexicon_is_refused(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_LISTED", 2)
    entries = spark.createDataFrame([(k, f"k{k}", ["a"]) for k in range(3)], "ord int, key string, signals array<string>")
    with pytest.raises(ValueError):
        X.phrase_hits(spark.createDataFrame([(1, "a")], "doc_id long, text string"), entries)
