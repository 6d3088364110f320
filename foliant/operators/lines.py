"""Documents to lines, and what single lines tell: titles, input mode, line classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import WHITE, strip, title_case, word_count

# fixed values: line patterns of the Markdown dialect
TASK = r"^(\s*)[-*]\s+\[([ xX])\]\s+(.+)$"
LIST = r"^(?:[-*]\s+|\d+\.\s+)"
HEADING = r"^(#{1,6})\s+(.+)$"
IMAGE = r"^!\[([^\]]*)\]\(([^)]+)\)\s*$"
CAPTION = r"^[*_]([^*_].+?)[*_]$"
DIVIDER = r"^[-_*]{3,}$"
SEPARATOR = r"^\|[-\s|:]+\|$"
CALLOUTS = (r"(?i)^\*\*(?:Important|Critical|Note|Key Rule)\*\*\s*[:\-]?\s*(.+)", r"(?i)^(?:Important|Critical|Key Rule)\s*[:\-]\s*(.+)")
WARNINGS = (r"(?i)^\*\*(?:Warning|Danger|Alert)\*\*\s*[:\-]?\s*(.+)", r"(?i)^(?:Warning|Danger|Alert)\s*[:\-]\s*(.+)")
RELATIONSHIP = r"(?i)^(?:Relationship\s*[:\-]\s*(.+)|(?:Allied with|Enemy of|Mentor to|Rival of|Friend of|Partner of)\s+(.+))"
TIMELINE = r"(?i)^[-*]?\s*(?:Year\s+\d+|\d{4}|[0-9A-Za-z_]+ \d+,? \d{4})\s*[:\-]\s*(.+)"
DEFINITION = r"(?i)^(?:Definition|Term)\s*[:\-]\s*(.+)"
STOP_PARAGRAPH = r"(?i)^(?:Warning|Danger|Alert|Important|Critical|Note|Key Rule|Relationship|Allied with|Enemy of|Mentor to|Definition|Term|See also|Reference)\s*[:\-]"
MODE_SIGNS = ("## ", "### ", "**", "```", "> ", "---", "- [", "| ")
NON_TITLES = ("dedication", "copyright", "contents", "table of contents", "acknowledgments", "acknowledgements", "also by", "praise for")


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, raw, line): the lines of every stripped text, from 0."""
    rows = docs.select("doc_id", F.posexplode(F.split(strip(F.coalesce(F.col(text), F.lit(""))), r"\R", -1)).alias("line_no", "raw"))
    return rows.withColumn("line", strip(F.col("raw")))


def line_stats(lines: DataFrame) -> DataFrame:
    """Per document: lines, non-blank lines, their mean length and the limit of a short line."""
    full = F.col("line") != ""
    mean = F.avg(F.when(full, F.length("line")))
    out = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(full).alias("n_full"), F.coalesce(mean, F.lit(0.0)).alias("avg_len"))
    return out.withColumn("short_limit", F.least(F.greatest(F.floor(F.col("avg_len") * 0.45), F.lit(15)), F.lit(60)))


def input_mode(docs: DataFrame) -> DataFrame:
    """(doc_id, mode): markdown, plain or raw by the signs in a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    signs = sum((F.contains(text, F.lit(x)).cast("int") for x in MODE_SIGNS), F.lit(0))
    lines = F.transform(F.split(strip(text), r"\R", -1), strip)
    caps = F.filter(lines, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) < 60))
    hits = F.size(caps) + F.size(F.filter(lines, lambda x: x.rlike(r"^\d+[.)]\s+"))) + F.size(F.filter(lines, lambda x: x.rlike(r"^[-•*]\s+")))
    mode = F.when((signs >= 1) | text.rlike(r"(?m)^# .+"), "markdown").when(hits >= 2, "plain").otherwise("raw")
    return docs.select("doc_id", mode.alias("mode"))


def titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title): the first level-1 heading that is no front matter."""
    name = strip(F.substr("line", F.lit(3)))
    good = F.col("line").startswith("# ") & ~F.regexp_replace(F.lower(name), r"[.:]+$", "").isin(*NON_TITLES)
    return lines.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(good, name), F.when(good, F.col("line_no"))), F.lit("Untitled Document")).alias("title"))


def fences(lines: DataFrame) -> DataFrame:
    """lines with fence (how many fence lines up to here), is_fence and in_code."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("is_fence", F.col("line").startswith("```"))
    marked = marked.withColumn("fence", F.sum(F.col("is_fence").cast("int")).over(w))
    return marked.withColumn("in_code", ~F.col("is_fence") & (F.col("fence") % 2 == 1))


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def classify(lines: DataFrame) -> DataFrame:
    """lines outside code with ``kind`` by the first rule that fits; code lines are ``code``, fences ``fence``."""
    x = F.col("line")
    kind = (
        F.when(F.col("is_fence"), "fence").when(F.col("in_code"), "code").when(F.col("raw").rlike(TASK), "task").when(x == "", "blank")
        .when(x.rlike(HEADING), "heading").when(x.rlike(IMAGE), "image").when(x.rlike(DIVIDER), "divider").when(x.startswith("|"), "table")
        .when(x.startswith("> "), "quote").when(x.rlike(LIST), "list").when(_any(x, CALLOUTS), "callout").when(_any(x, WARNINGS), "warning")
        .when(x.rlike(RELATIONSHIP), "relationship").when(x.rlike(TIMELINE), "timeline_event").when(x.rlike(DEFINITION), "definition").otherwise("paragraph")
    )
    return fences(lines).withColumn("kind", kind)


# fixed values: patterns of the classifier of unformatted text
RAW_RULES = (
    ("warning", r"(?i)^(?:Warning|Danger|Alert|Caution)\s*[:\-–]\s*(.+)"),
    ("callout", r"(?i)^(?:Note|Important|Critical|Key Rule|Remember|NB)\s*[:\-–]\s*(.+)"),
    ("relationship", r"(?i)^(?:Relationship|Allied with|Enemy of|Mentor to|Rival of|Friend of|Partner of|Married to|Sibling of)\s*[:\-–]?\s*(.+)"),
    ("timeline", r"(?i)^(?:Year\s+\d{3,4}|\d{4}|[0-9A-Za-z_]+ \d{1,2},?\s+\d{4})\s*[:\-–]\s*.+"),
    ("reference", r"(?i)^(?:See also|Reference|Source|Cf\.|Ibid\.|Op\. cit\.)\s*[:\-]"),
    ("quote", '^["“](.+)["”]\\s*(?:[-—]\\s*(.+))?$'),
    ("ordered_item", r"^(\d+)[.):]\s+(.+)"),
    ("list_item", r"^[-•*·→▸▹]\s+(.+)"),
)
#: The group of an item's pattern that is its text.
RAW_ITEMS = {"ordered_item": 2, "list_item": 1}
HEADING_WORDS = (
    r"(?i)^(?:Introduction|Overview|Summary|Background|Conclusion|Abstract|Appendix|References|Methods?|Results?|Discussion|Analysis|Part|Chapter|Section|Contents?|Index|Preface|Foreword|"
    r"Characters?|Locations?|Timeline|Rules?|Notes?|Settings?|Findings?|Recommendations?|Objectives?)\b"
)
COLON_LABEL = r"^([A-Z][A-Za-z\s]{1,35}):\s*(.+)?$"
RAW_DEFINITION = r"^([A-Z][a-zA-Z\s]{1,30})\s*[:\-–]\s+([A-Z].{10,})"


def classify_raw(lines: DataFrame) -> DataFrame:
    """lines with ``tag`` and ``content`` of the classifier of unformatted text; short lines are judged by the document's mean."""
    x = F.col("line")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    own = lines.join(line_stats(lines).select("doc_id", "short_limit"), "doc_id").withColumn("after_blank", F.coalesce(F.lag("line").over(w), F.lit("")) == "")
    letters = strip(F.regexp_replace(x, r"[^a-zA-Z\s]", ""))
    n = word_count(x)
    label, rest = strip(F.regexp_extract(x, COLON_LABEL, 1)), strip(F.regexp_extract(x, COLON_LABEL, 2))
    labelled = x.rlike(COLON_LABEL)
    titled = F.forall(F.split(x, rf"{WHITE}+"), lambda v: ~v.rlike(r"^\p{L}") | v.rlike(r"^\p{Lu}"))
    short = (F.length(x) <= F.col("short_limit")) & F.col("after_blank") & titled
    caps = (letters != "") & (letters == F.upper(letters)) & (F.length(x) <= 60) & (n <= 8)
    alone = labelled & (rest == "")
    rules = [(x == "", "blank", x)]
    rules += [(x.rlike(pattern), name, strip(F.regexp_extract(x, pattern, RAW_ITEMS[name])) if name in RAW_ITEMS else x) for name, pattern in RAW_RULES]
    rules += [
        (caps & (n <= 3), "h1", title_case(x)),
        (caps, "h2", title_case(x)),
        ((labelled & label.rlike(HEADING_WORDS)) | (alone & (word_count(label) <= 4)), "h2", label),
        (labelled & (word_count(label) <= 3) & (F.length(rest) > 15), "definition", x),
        (alone & (word_count(label) <= 5), "h3", label),
        (short & (n <= 3), "h3_entity", x),
        (short & (n <= 5), "h2", x),
        (x.rlike(HEADING_WORDS) & (n <= 4), "h2", x),
        (x.rlike(r"\t") | (x.rlike(r" {4,}") & (n >= 3)), "table_row", x),
        (x.rlike(RAW_DEFINITION) & (word_count(F.regexp_extract(x, RAW_DEFINITION, 1)) <= 3), "definition", x),
    ]
    found = F.coalesce(*[F.when(rule, F.struct(F.lit(tag).alias("tag"), content.alias("content"))) for rule, tag, content in rules], F.struct(F.lit("para").alias("tag"), x.alias("content")))
    return own.withColumn("_found", found).select("*", "_found.tag", "_found.content").drop("after_blank", "_found")


def plain_headings(lines: DataFrame) -> DataFrame:
    """Lines of plain text as Markdown: short lines in capitals become level-2 headings."""
    x = F.col("line")
    caps = (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) < 60) & (word_count(x) <= 6)
    return lines.withColumn("markdown", F.when(caps, F.concat(F.lit("## "), title_case(x))).otherwise(x))
