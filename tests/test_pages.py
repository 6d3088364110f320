"""Documents as HTML, worked out by hand and against a recursive version."""

import random

from pyspark.sql import functions as F

from foliant.operators import blocks as B
from foliant.operators import lines as L
from foliant.operators import pages as G


def nested(rows):
    """HTML of (tier, text) rows by recursion."""
    html, k = "", 0
    while k < len(rows):
        tier, text = rows[k]
        end = next((j for j in range(k + 1, len(rows)) if rows[j][0] <= tier), len(rows))
        inner = nested(rows[k + 1 : end])
        html += f'<li><label class="task-row "><input type="checkbox" disabled><span>{text}</span></label>{inner}</li>'
        k = end
    return f'<ul class="task-subtasks">{html}</ul>' if rows else ""


def test_nested_tasks(spark):
    r = random.Random(4)
    trees = [[0], [0, 1, 2, 3, 1], [0, *range(1, 45), 3, 44 - 3]] + [[0] + [r.choice([1, 2, 3, 5, 9]) for _ in range(25)] for _ in range(6)]
    docs = [(k, "\n".join(f"{'  ' * d}- [ ] t{i}" for i, d in enumerate(depths))) for k, depths in enumerate(trees)]
    tasks = B.tasks(L.classify(L.split_lines(spark.createDataFrame(docs, "doc_id long, text string"))))
    got = {x["doc_id"]: x["task_html"] for x in G.task_trees(tasks).collect()}
    for k, depths in enumerate(trees):
        stack, rows = [], []
        for i, d in enumerate(depths):
            stack = [x for x in stack if x < d]
            rows.append((len(stack), f"t{i}"))
            stack.append(d)
        assert got[k] == nested(rows).removeprefix('<ul class="task-subtasks"><li>').removesuffix("</li></ul>")


def test_bodies(spark):
    schema = "doc_id long, seq int, type string, level int, content string, importance double, src string, caption string, language string"
    rows = [(1, 0, "heading", 1, " my TITLE ", 0.0, None, None, None), (1, 1, "entity", 3, "Queen of x", 75.0, None, None, None), (1, 2, "code", 0, "a < b", 0.0, None, None, "sql"), (2, 0, "heading", 2, "Part", 0.0, None, None, None)]
    titles = spark.createDataFrame([(1, "My Title"), (2, "A & B"), (3, "None")], "doc_id long, title string")
    projects = spark.createDataFrame([(1, "Research Notes"), (2, "Document")], "doc_id long, project string")
    got = {r["doc_id"]: r["body"] for r in G.bodies(spark.createDataFrame(rows, schema), titles, projects).collect()}
    assert got == {
        1: '<h1>My Title</h1>\n<p class="doc-meta">Research Notes &mdash; 3 blocks detected</p>\n<div class="entity-card entity importance-high"><div class="entity-name">♔ Queen of x</div></div>\n<pre><code class="language-sql">a &lt; b</code></pre>',
        2: "<h1>A &amp; B</h1>\n<h2>Part</h2>",
        3: "<h1>None</h1>",
    }


def test_page_and_frame(spark):
    row = spark.range(1).select(G.page(F.lit("a<b"), G.framed(F.lit("x"), F.lit("+"), F.lit(None).cast("string"), F.lit(True)), F.lit("p {}")).alias("h")).first()
    assert "<title>a&lt;b</title>\n<style>\np {}\n</style>" in row["h"]
    assert '<body>\n<div class="page-frame page-frame-border"><div class="margin-ornament margin-top" aria-hidden="true">+</div>x</div>\n</body>' in row["h"]
