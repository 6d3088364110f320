"""Pages of positioned words with texts worked out by hand; all of them are documents of one run."""

import pytest

from foliant.operators import reading as R

WIDE = 612.0


class Book:
    """Collects words; a line is given as texts at an x, each 40 points wide, 45 apart."""

    def __init__(self):
        self.words = []

    def line(self, page, top, x, texts, size=10.0):
        for k, t in enumerate(texts.split(" ")):
            self.words.append((page, WIDE, len(self.words), t, x + 45.0 * k, x + 45.0 * k + 40, float(top), size))
        return self

    def columns(self, page, top, n, left="l", right="r"):
        for k in range(n):
            self.line(page, top + 12 * k, 60, f"{left}{k} a b c").line(page, top + 12 * k + 1, 340, f"{right}{k} d e f")
        return self

    def lines(self, *texts, per_page=2, step=12.0, size=10.0):
        for k, t in enumerate(texts):
            self.line(k // per_page, 60 + step * (k % per_page), 60, t, size)
        return self


CASES = {}  # name: (book, markdown)


def case(name, book, want):
    CASES[name] = (book, want)


def read(left, right):
    return " ".join([f"{left}{k} a b c" for k in range(12)] + [f"{right}{k} d e f" for k in range(12)])


case("spanning title parts the columns", Book().columns(0, 100, 12).line(0, 250, 200, "Title right across", 16.0).columns(0, 270, 12, "m", "s"), f"{read('l', 'r')}\n\n# Title right across\n\n{read('m', 's')}")

edges, kept = Book(), []
for page in range(5):
    edges.line(page, 20, 60, "My Book" if page != 2 else "Other Head")
    kept += ["Other Head"] if page == 2 else []
    for k in range(4):
        edges.line(page, 60 + 12 * k, 60, f"p{page}r{k} x")
        kept.append(f"p{page}r{k} x")
    edges.line(page, 200, 300, str(page + 1))
case("running heads and folios go", edges.line(5, 60, 60, "6"), " ".join(kept))
case("three pages are too few for a running head", Book().lines("Head x", "a b", "Head x", "c d", "Head x", "e f"), "Head x a b Head x c d Head x e f")
case("a number close to the text stays", Book().lines("one two", "three four", "7", per_page=3), "one two three four 7")

for name, lines, want in [
    ("parted", ["ab exam-", "ple here", "more"], "ab example here more"),
    ("capital behind", ["ab exam-", "Ple here"], "ab exam- Ple here"),
    ("two hyphens", ["ab exam--", "ple here"], "ab exam-- ple here"),
    ("short", ["ab x-", "ple here"], "ab x- ple here"),
    ("line of the word only", ["ab exam-", "ple-", "tion", "end"], "ab exampletion end"),
    ("short goes on", ["ab exam-", "p-", "le x", "end"], "ab example x end"),
    ("one after another", ["ab exam-", "ple cross-", "ing x"], "ab example crossing x"),
    ("nothing behind", ["only-"], "only-"),
]:
    case(f"parted words: {name}", Book().lines(*lines), want)

for name, caps, want in [
    ("one", ["T"], "The story of it"), ("two", ["A", "T"], "AThe story of it"), ("three are a heading", ["A", "B", "C"], "# ABC\n\nhe story of it"), ("long", ["Tho"], "# Tho\n\nhe story of it"), ("digit", ["7"], "7 he story of it"),
]:
    book = Book()
    for k, c in enumerate(caps):
        book.line(0, 60 + 30 * k, 60, c, 30.0)
    case(f"initials: {name}", book.line(0, 60 + 30 * len(caps), 60, "he story of it").line(0, 72 + 30 * len(caps), 60, "and so on and so on"), want + " and so on and so on")
case("an initial of the body's size stays", Book().lines("I", "was here"), "I was here")
case("an initial at the end stays", Book().line(0, 60, 60, "some words of text").line(0, 90, 60, "T", 30.0), "some words of text T")

book = Book().line(0, 40, 60, "A Plan", 14.0).line(0, 60, 60, "in two lines", 14.0)
for k, (x, t) in enumerate([(60, "first line"), (60, "goes on"), (75, "indented one"), (60, "goes on too"), (60, "and on")]):
    book.line(0, 80 + 12 * k, x, t)
book.line(1, 60, 60, "over the page").line(1, 80, 60, "Is", 14.0).line(1, 100, 75, "\ue000 bullet")
case("paragraphs and headings", book, "# A Plan in two lines\n\nfirst line goes on\n\nindented one goes on too and on over the page Is\n\n- bullet")
case("speakers start paragraphs in a script", Book().lines(*[t for k in range(20) for t in ("MARK ANTONY", f"says {k}")], per_page=20), "\n\n".join(f"MARK ANTONY says {k}" for k in range(20)))
case("nineteen lines are no script", Book().lines(*["MARK ANTONY"] * 19, per_page=19), " ".join(["MARK ANTONY"] * 19))


def table(spark, *books):
    rows = [(k, *w) for k, b in enumerate(books) for w in b.words]
    return spark.createDataFrame(rows, "doc_id long, page int, page_width double, word_seq int, text string, x0 double, x1 double, top double, size double")


@pytest.fixture(scope="module")
def found(spark):
    rows = R.markdown(table(spark, *[b for b, _ in CASES.values()])).collect()
    assert len(rows) == len(CASES)
    return {list(CASES)[r["doc_id"]]: r["markdown"] for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    assert found[name] == CASES[name][1]


def test_gutters(spark):
    enough, few, narrow, lopsided = Book(), Book(), Book(), Book()
    for k in range(20):
        for book, n in ((enough, 12), (few, 11)):
            if k < n:
                book.line(0, 100 + 12 * k, 60, "a b c d").line(0, 100 + 12 * k, 340, "d e f g")
        narrow.line(0, 100 + 12 * k, 60, "a b c d e").line(0, 100 + 12 * k, 290, "a b c d e")  # 5 points between
        lopsided.line(0, 100 + 12 * k, 60, "a b c d")
    lopsided.line(0, 100, 340, "x")
    rows = R.gutters(R.rows_of(table(spark, enough, few, narrow, lopsided))).collect()
    assert [r["doc_id"] for r in rows] == [0] and 235 < rows[0]["left"] < 245 and 335 < rows[0]["right"] <= 340


def test_rows_do_not_chain(spark):
    book = Book()
    for k, top in enumerate([10.0, 12.5, 13.0, 13.5, 16.0, 17.0]):
        book.line(0, top, 60 + 50 * k, f"w{k}")
    rows = {r["text"]: r["row"] for r in R.rows_of(table(spark, book)).collect()}
    assert rows == {"w0": 0, "w1": 0, "w2": 0, "w3": 1, "w4": 1, "w5": 2}


def test_no_words(spark):
    assert R.markdown(table(spark, Book().lines("x")).where("false")).collect() == []


def test_lines_are_made_in_one_pass(spark):
    """The pages of words are read once, without a join, and a filter repeats none of their expressions."""
    words = table(spark, *[b for b, _ in CASES.values()])
    plan = R.body_lines(R.paged(words))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    assert "array_sort" not in plan and not any("sort_array" in line for line in plan.splitlines() if "Filter " in line)
