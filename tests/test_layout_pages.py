"""Pages given whole: the same lines as from rows of words, and texts dealt once, in place of words."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from foliant.operators import layout as Y

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_words_give_the_same_lines(spark):
    words = [(1, 0, 14.0, 50.0, 3, 60.0, 9.0, "c"), (1, 0, 10.0, 70.0, 1, 80.0, 9.0, "b"), (1, 0, 12.5, 50.0, 2, 60.0, 11.0, "a"), (1, 1, 5.0, 1.0, 4, 2.0, 9.0, "d")]
    rows = spark.createDataFrame(words, "doc_id long, page int, top double, x0 double, word_seq int, x1 double, size double, text string")
    got = [sorted(Y.visual_lines(x).collect()) for x in (rows, Y.pages_of(rows))]
    assert got[0] == got[1] == [(1, 0, 0, 10.0, 50.0, 80.0, 11.0, "a b"), (1, 0, 1, 14.0, 50.0, 60.0, 9.0, "c"), (1, 1, 0, 5.0, 1.0, 2.0, 9.0, "d")]


@pytest.mark.parametrize("name", ["page_folios", "pdf_lines", "dehyphenated", "running_edges", "line_gaps", "page_columns", "reading_order", "page_edges"])
def test_texts_are_dealt_once(spark, name):
    assert len(re.findall(r"\bExchange hashpartitioning", plan(e.queries()[name](spark, SF)))) == 1


def test_pages_of_lines_and_lines_give_the_same(spark):
    words = [(d, p, 12.0 * k * (1 + p // 4) + p % 2 * k * k, 50.0 + 12 * (k % 3), p * 9 + k, 90.0, 9.0, "head" if k == 0 else "foot" if k == 5 and p % 2 else f"w{p}{k}") for d in (1, 2) for p in range(6 * d - 5) for k in range(2 + p % 5)]
    rows = spark.createDataFrame(words, "doc_id long, page int, top double, x0 double, word_seq int, x1 double, size double, text string")
    lines, pages = Y.visual_lines(rows), Y.page_lines(rows)
    for of in (Y.running_edges, Y.median_gap, Y.left_margin):
        assert sorted(of(pages).collect()) == sorted(of(lines).collect()) != []
    ends = Y.page_lines(rows, fields=("line", "text"), ends=True)
    assert sorted(Y.running_edges(ends).collect()) == [(2, "first", "head")]
    none = pages.select("doc_id", "page", F.filter("lines", lambda _: F.lit(False)).alias("lines"))
    assert Y.running_edges(none, 0).count() == Y.median_gap(none).count() == Y.left_margin(none).count() == 0


@pytest.mark.parametrize("name", ["running_edges", "line_gaps", "margins"])
def test_no_row_of_a_line_is_sorted(spark, name):
    text = e.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # pages are made once: no filter stands below that makes them too
    assert "Filter (size" not in text and "Filter ((size" not in text and "lag(" not in text and "min_by" not in text and "inline(transform(transform(" not in text
