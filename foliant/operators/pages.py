"""Whole documents as HTML: nested tasks, the body of a document and the page around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import html_escaped, strip
from foliant.operators import topics as T

#: A type of project that is not worth naming.
PLAIN = "Document"


def task_trees(tasks: DataFrame) -> DataFrame:
    """(doc_id, root, task_html): each root task with its sub-tasks as nested lists.

    tasks are the rows of a task tree in line order, which is the order of the nested text, so each
    row adds its own piece: from the tier before it opens one list or closes as many as it
    leaves. No level is put together from the one below, however deep the tree.
    """
    w = Window.partitionBy("doc_id", "root").orderBy("line_no")
    before = F.lag("tier").over(w)
    deeper = F.lit('<ul class="task-subtasks"><li>')
    beside = F.concat(F.lit("</li>"), F.repeat(F.lit("</ul></li>"), before - F.col("tier")), F.lit("<li>"))
    opening = F.when(before.isNull(), F.lit("")).when(F.col("tier") > before, deeper).otherwise(beside)
    own = tasks.withColumn("piece", F.concat(opening, T.task_row(F.col("text"), F.col("checked"))))
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "piece", "tier")))
    whole = own.groupBy("doc_id", "root").agg(pieces.alias("p"))
    html = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.repeat(F.lit("</li></ul>"), F.element_at("p", -1)["tier"]))
    return whole.select("doc_id", "root", html.alias("task_html"))


def with_task_trees(blocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """blocks with ``task_html``: the k-th task block of a document is its k-th root task."""
    place = lambda by: F.row_number().over(Window.partitionBy("doc_id").orderBy(by))
    trees = task_trees(tasks).select("doc_id", place("root").alias("_k"), "task_html")
    of_type = F.count_if(F.col("type") == "task").over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    own = blocks.withColumn("_k", F.when(F.col("type") == "task", of_type))
    return own.join(trees, ["doc_id", "_k"], "left").drop("_k")


def bodies(blocks: DataFrame, titles: DataFrame, projects: DataFrame) -> DataFrame:
    """(doc_id, title, body): title, kind of project and all blocks, but for headings that repeat the title.

    titles has a row for every document (doc_id, title), projects (doc_id, project) may lack some.
    """
    own = T.block_html(blocks).join(titles, "doc_id")
    repeats = (F.col("type") == "heading") & (F.lower(strip(F.col("content"))) == F.lower(strip(F.col("title"))))
    shown = F.when(~repeats, F.struct("seq", "html"))
    parts = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(shown)).alias("parts"))
    rows = titles.join(parts, "doc_id", "left").join(projects.select("doc_id", "project"), "doc_id", "left")
    head = F.array(F.concat(F.lit("<h1>"), html_escaped(F.col("title")), F.lit("</h1>")))
    meta = F.concat(F.lit('<p class="doc-meta">'), html_escaped(F.col("project")), F.lit(" &mdash; "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" blocks detected</p>"))
    named = F.when(F.col("project").isNotNull() & (F.col("project") != PLAIN), F.array(meta)).otherwise(F.array().cast("array<string>"))
    blocks_html = F.coalesce(F.transform("parts", lambda x: x["html"]), F.array().cast("array<string>"))
    return rows.select("doc_id", "title", F.array_join(F.concat(head, named, blocks_html), "\n").alias("body"))


def fragment(css: Column, body: Column, icons: Column) -> Column:
    """The trailer that lets another page take a document's parts: a comment with them as JSON."""
    return F.concat(F.lit("<!--FRAGMENT:"), F.to_json(F.struct(css.alias("css"), body.alias("html"), icons.alias("fa"))), F.lit(":FRAGMENT-->"))


def framed(body: Column, primary: Column, secondary: Column, border: Column) -> Column:
    """A body with an ornament above and one below, and a border if asked for; a null ornament leaves them out."""
    rule = lambda where, x: F.when(x.isNotNull(), F.concat(F.lit(f'<div class="margin-ornament margin-{where}" aria-hidden="true">'), html_escaped(x), F.lit("</div>"))).otherwise("")
    return F.concat(F.lit('<div class="page-frame'), F.when(border, " page-frame-border").otherwise(""), F.lit('">'), rule("top", primary), body, rule("bottom", secondary), F.lit("</div>"))


def page(title: Column, body: Column, css: Column) -> Column:
    """The whole page of a document."""
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>'), html_escaped(title),
        F.lit("</title>\n<style>\n"), css, F.lit("\n</style>\n</head>\n<body>\n"), body, F.lit("\n</body>\n</html>"),
    )
