"""Queries on unformatted text. The texts are made from parts, ten lines of one of sixteen shapes each.

The SQL knows which shape a line has, so what it expects of the classifier is stated by hand for each shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from foliant.operators import details as D
from foliant.operators import lines as L
from foliant.session import table

N, B_, T = "p_name", "p_brand", "p_type"
#: Per shape: the pieces of a line (a column's name or a literal), the tag, and the pieces of its content where that is another.
SHAPES = (
    ([""], "blank", None),
    ([N, " of the ", N, " is what most of the buyers in the north asked for last year"], "para", None),
    ([N, " and ", N, " were sold together in the autumn. Warning: the stock of ", N, " is low"], "para", None),
    (["- ", N, " x ", B_], "list_item", [N, " x ", B_]),
    (["• ", N], "list_item", [N]),
    (["3. ", N, " first"], "ordered_item", [N, " first"]),
    ([N, "\t", B_, "\t", T], "table_row", None),
    ([N, "    ", B_], "table_row", None),
    (["STOCK LIST"], "h1", ["Stock List"]),
    (["ALL THE PARTS' NAMES"], "h2", ["All The Parts' Names"]),
    (["Characters: ", N], "h2", ["Characters"]),
    (["Goods of note:"], "h2", ["Goods of note"]),
    (["1999: ", N, " was founded"], "timeline", None),
    (["“No ", N, " without ", N, "” - A buyer"], "quote", None),
    (["Note: count ", N], "callout", None),
    (["Iron: A metal that every ", N, " is made of"], "definition", None),
)


def _shape(k):
    """Three lines in a row have one shape; rows of a table differ in width, and every fifth item of a list has a number."""
    base = (F.floor(k / 3) * 7 + F.floor(k / 37)) % len(SHAPES)
    return F.when((base == 6) & (k % 2 == 1), 7).when((base == 3) & (k % 5 == 0), 5).otherwise(base)


def raw_texts(spark, sf_dir):
    """(doc_id, text): ten parts to a text."""
    own = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    piece = lambda p: F.col(p) if p in (N, B_, T) else F.lit(p)
    line = reduce(lambda acc, x: acc.when(_shape(F.col("k")) == x[0], F.concat(*map(piece, x[1][0]))), enumerate(SHAPES[1:], 1), F.when(_shape(F.col("k")) == 0, ""))
    rows = own.select(F.floor(F.col("k") / 10).alias("doc_id"), "k", line.alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]), "\n").alias("text"))


def _classified(spark, sf_dir):
    return L.classify_raw(L.split_lines(raw_texts(spark, sf_dir)))


def raw_contents(spark, sf_dir):
    return _classified(spark, sf_dir).where("tag <> 'blank'").select("doc_id", "tag", "content")


def raw_items(spark, sf_dir):
    own = D.raw_items(_classified(spark, sf_dir)).where("tag <> 'blank'")
    return own.select("doc_id", "tag", F.array_join("contents", " / ").alias("contents"))


def raw_markdown(spark, sf_dir):
    return D.raw_markdown(_classified(spark, sf_dir)).select("doc_id", F.regexp_replace("markdown", r"^\n+|\n+$", "").alias("markdown"))


QUERIES = {f.__name__: f for f in (raw_contents, raw_items, raw_markdown)}


def _pieces(parts) -> str:
    return " || ".join(p if p in (N, B_, T) else "'" + p.replace("'", "''") + "'" for p in parts).replace("\t", "' || chr(9) || '")


def _case(values) -> str:
    return "CASE sh " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_RAW = f"""p AS (SELECT *, p_partkey // 10 AS doc_id, p_partkey AS k, (p_partkey // 3 * 7 + p_partkey // 37) % {len(SHAPES)} AS base, CASE WHEN base = 6 AND k % 2 = 1 THEN 7 WHEN base = 3 AND k % 5 = 0 THEN 5 ELSE base END AS sh FROM part),
l AS (SELECT doc_id, k, sh, {_case(["'" + tag + "'" for _, tag, _ in SHAPES])} AS tag, {_case([_pieces(content or line) for line, _, content in SHAPES])} AS content FROM p),
g AS (SELECT *, CASE WHEN tag IN ('list_item', 'ordered_item', 'table_row', 'para') AND lag(tag) OVER (PARTITION BY doc_id ORDER BY k) = tag THEN 0 ELSE 1 END AS start FROM l),
i AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY k) AS item FROM g),
m0 AS (SELECT doc_id, item, tag, list(content ORDER BY k) AS cs, list(sh ORDER BY k) AS shs FROM i GROUP BY ALL),
m AS (SELECT doc_id, item, CASE WHEN tag = 'table_row' AND len(cs) = 1 THEN 'para' WHEN tag = 'table_row' THEN 'table' WHEN tag IN ('list_item', 'ordered_item') THEN 'list' ELSE tag END AS tag, cs, shs FROM m0),
h AS (SELECT *, sum((tag IN ('h1', 'h2'))::INT) OVER (PARTITION BY doc_id ORDER BY item) AS top,
 list_transform(cs, lambda c: CASE WHEN contains(c, chr(9)) THEN string_split(c, chr(9)) ELSE string_split(c, '    ') END) AS cells FROM m),
x AS (SELECT *, len(cells[1]) AS w0, list_max(list_transform(cells, lambda c: len(c))) AS wide FROM h),
y AS (SELECT doc_id, item, CASE tag WHEN 'list' THEN '- ' || array_to_string(cs, chr(10) || '- ')
 WHEN 'table' THEN array_to_string(list_concat(['| ' || array_to_string(list_resize(cells[1], wide, ''), ' | ') || ' |', '| ' || array_to_string(list_resize(['---'], wide, '---'), ' | ') || ' |'], list_transform(cells[2:], lambda c: '| ' || array_to_string(list_resize(c, wide, ''), ' | ') || ' |')), chr(10))
 WHEN 'para' THEN replace(array_to_string(cs, ' '), '. Warning:', '.' || chr(10) || 'Warning:') WHEN 'h1' THEN '# ' || cs[1] WHEN 'h2' THEN CASE WHEN top = 1 THEN '# ' ELSE '## ' END || cs[1] WHEN 'timeline' THEN '- ' || cs[1] WHEN 'quote' THEN '> ' || cs[1] ELSE cs[1] END AS text FROM x)"""

SQL = {
    "raw_contents": f"WITH {_RAW} SELECT doc_id, tag, content FROM l WHERE tag <> 'blank'",
    "raw_items": f"WITH {_RAW} SELECT doc_id, tag, array_to_string(cs, ' / ') AS contents FROM m WHERE tag <> 'blank'",
    "raw_markdown": f"WITH {_RAW} SELECT doc_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY item), chr(10)) AS markdown FROM y GROUP BY doc_id",
}
