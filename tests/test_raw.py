"""Unformatted texts with Markdown and blocks worked out by hand."""

import pytest

from foliant.operators import blocks as B
from foliant.operators import details as D
from foliant.operators import lines as L

CASES = {
    "capitals and a definition": ("CAST\n\nIron: A metal that suppresses magic", "# Cast\n\n\n\nIron: A metal that suppresses magic\n"),
    "list items of both kinds part": ("- a\n• b\n1. c\n2) d\n- e", "- a\n- b\n\n- c\n- d\n\n- e\n"),
    "a blank parts items": ("- a\n\n- b", "- a\n\n\n\n- b\n"),
    "first heading of level 2 is the title": ("Characters:\n\nsome long words that follow here\n\nLocations:", "# Characters\n\n\n\nsome long words that follow here\n\n\n\n## Locations\n"),
    "a later title does not change it": ("Characters:\n\nCAST", "# Characters\n\n\n\n# Cast\n"),
    "paragraph lines join, signals part": ("the first line goes on and on\nuntil here. Note: keep it dry. And more of it", "the first line goes on and on until here.\nNote: keep it dry. And more of it\n"),
    "rows of a table": ("a\tb\tc\nd    e f g\nlonger text of a paragraph that follows", "| a | b | c |\n| --- | --- | --- |\n| d | e f g |  |\n\nlonger text of a paragraph that follows\n"),
    "one row is a paragraph of its own": ("longer text of a paragraph before\na\tb\nlonger text of a paragraph behind", "longer text of a paragraph before\n\na\tb\n\nlonger text of a paragraph behind\n"),
    "dates are items, quotes are quotes": ("1999: founded\n“To be” - Someone", "- 1999: founded\n\n> “To be” - Someone\n"),
    "capitals keep their colon": ("CAST AND CREW:", "# Cast And Crew:\n"),
}


@pytest.fixture(scope="module")
def markdown(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(CASES.values())], "doc_id long, text string")
    return D.raw_markdown(L.classify_raw(L.split_lines(docs)))


@pytest.fixture(scope="module")
def found(markdown):
    return {list(CASES)[r["doc_id"]]: r["markdown"] for r in markdown.collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    assert found[name] == CASES[name][1]


def test_through_to_blocks(markdown):
    own = B.retype(B.parse(L.split_lines(markdown.withColumnRenamed("markdown", "text"))))
    got = {}
    for r in own.orderBy("doc_id", "seq").collect():
        got.setdefault(list(CASES)[r["doc_id"]], []).append((r["type"], r["content"]))
    assert got["capitals and a definition"] == [("heading", "Cast"), ("paragraph", "Iron: A metal that suppresses magic")]
    assert got["dates are items, quotes are quotes"] == [("list", "1999: founded"), ("quote", "“To be” - Someone")]
