import random

from foliant.operators import blocks as B
from foliant.operators import lines as L
from foliant.operators import scores as S
from foliant.operators import topics as T


def parse(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return B.retype(B.parse(L.split_lines(docs)))


def rows(df):
    return [(r["type"], r["level"], r["content"]) for r in df.orderBy("doc_id", "seq").collect()]


def test_whole_document(spark):
    text = "# Alpha Notes\n\nIntro text one.\nIntro text two.\n\n### Mira Vale\nA scout.\n\n- one\n- two\n\n| k | v |\n|---|---|\n| a | 1 |\n\n> quoted\n\nWarning: hot"
    assert rows(parse(spark, text)) == [
        ("heading", 1, "Alpha Notes"), ("paragraph", 0, "Intro text one. Intro text two."), ("entity", 3, "Mira Vale"), ("paragraph", 0, "A scout."), ("list", 0, "one\ntwo"), ("table", 0, "| k | v |\n| a | 1 |"),
        ("quote", 0, "quoted"), ("warning", 0, "hot"),
    ]


def test_list_goes_on_around_code(spark):
    assert rows(parse(spark, "- a\n```\ncode\n```\n- b")) == [("code", 0, "code"), ("list", 0, "a\nb")]


def test_unclosed_fence_gives_nothing(spark):
    assert rows(parse(spark, "a\n\n```\ncode")) == [("paragraph", 0, "a")]


def test_paragraph_takes_in_lines_without_blank(spark):
    assert rows(parse(spark, "Text\n---\n1999: x\nWarning: y")) == [("paragraph", 0, "Text --- 1999: x"), ("warning", 0, "y")]


def test_empty_and_null(spark):
    assert rows(parse(spark, None, "", "  \n ")) == []


def test_task_tree(spark):
    docs = spark.createDataFrame([(1, "- [ ] a\n  - [x] b\n      - [ ] c\n  - [ ] d\n- [x] e")], "doc_id long, text string")
    got = B.tasks(L.classify(L.split_lines(docs))).orderBy("line_no").collect()
    assert [(r["text"], r["depth"], r["checked"], r["parent"], r["root"]) for r in got] == [("a", 0, False, None, 0), ("b", 1, True, 0, 0), ("c", 3, False, 1, 0), ("d", 1, False, 0, 0), ("e", 0, True, None, 4)]


def test_task_tree_of_any_depth(spark):
    """Against a stack, on depths up to 60 and with tabs, in two runs."""
    r = random.Random(8)
    docs, want = [], {}
    for doc in range(4):
        depths = list(range(61)) if doc == 0 else [r.choice([0, 1, 2, 3, 20, 41]) for _ in range(50)]
        lines, stack = [], []
        for k, d in enumerate(depths):
            if k == 30 and doc:
                lines.append("Text between")
                stack = []
            stack = [x for x in stack if x[0] < d]
            want[doc, len(lines)] = (d, stack[-1][1] if stack else None, stack[0][1] if stack else len(lines))
            stack.append((d, len(lines)))
            indent = "\t" * (d // 2) + "  " * (d % 2) if doc == 2 else " \t" * (d // 2) + "  " * (d % 2) if doc == 3 else "  " * d
            lines.append(f"{indent}- [ ] t{k}")
        docs.append((doc, "x\n" + "\n".join(lines)))
    got = B.tasks(L.classify(L.split_lines(spark.createDataFrame(docs, "doc_id long, text string")))).collect()
    assert {(x["doc_id"], x["line_no"] - 1): (x["depth"], None if x["parent"] is None else x["parent"] - 1, x["root"] - 1) for x in got} == want


def test_very_long_lines_stay_whole(spark):
    n = 2_000_000
    got = parse(spark, "# " + "a" * n + "\n\n> " + "b" * n).collect()
    assert sorted((r["type"], len(r["content"])) for r in got) == [("heading", n), ("quote", n)]
    docs = spark.createDataFrame([(1, "# " + "a" * n)], "doc_id long, text string")
    assert len(L.titles(L.split_lines(docs)).first()["title"]) == n


def fold(classes):
    """Starts of paragraphs by reading class by class: A starts, B breaks."""
    out, open_ = [], False
    for k, (a, b) in enumerate(classes):
        if b or not open_:
            open_ = a
            if a:
                out.append(k)
    return out


def test_paragraph_windows_match_a_fold(spark):
    r = random.Random(3)
    kinds = {"word": (True, False), "": (False, True), "- x": (False, True), "---": (False, False), "1999: y": (False, False), "Note: z": (True, True)}
    texts = ["\n".join(["s"] + [r.choice(list(kinds)) for _ in range(30)] + ["e"]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = B.paragraphs(L.classify(L.split_lines(docs))).where("para = line_no").collect()
    got = {}
    for x in marked:
        got.setdefault(x["doc_id"], []).append(x["line_no"])
    for k, text in enumerate(texts):
        classes = [kinds.get(x, (True, False)) for x in text.split("\n")]
        assert sorted(got.get(k, [])) == fold(classes), text


def test_importance_of_one_paragraph(spark):
    got = S.importance(parse(spark, "must note")).collect()
    assert got[0]["importance"] == 57.0


def test_project_type_needs_evidence(spark):
    own = parse(spark, "hypothesis methodology findings data analysis study", "hypothesis methodology findings data analysis", "questioning conquest")
    got = {r["doc_id"]: (r["project"], r["confidence"]) for r in S.project_type(S.project_scores(own)).collect()}
    assert got == {0: ("Research Notes", 95.0), 1: ("Document", 0.0), 2: ("Document", 0.0)}


def test_numeric_series(spark):
    got = T.numeric_series(parse(spark, "| n | v |\n| a | 1 |\n| b | 2,5 |\n| c | 3% |")).orderBy("row").collect()
    assert [(r["label"], r["value"]) for r in got] == [("a", 1.0), ("b", 25.0), ("c", 3.0)]


def test_importance_bounds(spark):
    from foliant.plans.score_queries import scored

    low, high = scored(spark, "/root/testdata/sf0.001").selectExpr("min(importance)", "max(importance)").first()
    assert 0 <= low <= high <= 100
