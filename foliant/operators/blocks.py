"""Lines to typed blocks with windows: runs, paragraphs, captions, order, sections and retyping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip, words
from foliant.operators import lines as L

# fixed values: words that are no names of entities
GENERIC_ENTITY = (
    "overview introduction summary background notes rules settings world timeline characters locations appendix references conclusion chapter section part contents index tasks todo to-do checklist "
    "entities entity data results methodology discussion analysis findings recommendations glossary resources credits acknowledgments acknowledgements dedication prologue epilogue foreword afterword "
    "goals objectives risks assumptions constraints scope definitions terminology team members requirements features roadmap milestones metrics budget cast plot themes setting worldbuilding lore "
    "factions organizations items equipment quests media gallery images attachments comments faq faqs meta misc miscellaneous other general details description specs specifications abstract "
    "prerequisites installation usage examples license changelog contributing about gods deities"
).split()
GENERIC_NAME = (
    "the a an and of in on at to for overview summary introduction background notes rules settings world timeline characters locations chapter section part appendix submitted by session class roll "
    "aim objective objectives program declaration certificate acknowledgement acknowledgment engagement school college university department subject assignment project report number date name"
).split()


def _doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def looks_like_entity(x: Column) -> Column:
    """A heading that names something: at most four words, capital first letter, no generic word."""
    own = words(F.lower(x))
    return (F.size(own) <= 4) & ~F.arrays_overlap(own, F.array(*map(F.lit, GENERIC_ENTITY))) & x.rlike(r"^\p{Lu}")


def looks_like_name(x: Column) -> Column:
    """The stricter test of the structure step."""
    own = words(x)
    plain = F.transform(own, lambda w: F.regexp_replace(F.lower(w), "^[:,&]+|[:,&]+$", ""))
    return (
        (F.size(own) > 0) & (F.size(own) <= 5) & ~strip(x).endswith(":") & ~x.rlike(r"\d")
        & ~F.exists(own, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))
        & F.forall(own, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
        & ~F.arrays_overlap(plain, F.array(*map(F.lit, GENERIC_NAME)))
    )


def paragraphs(lines: DataFrame) -> DataFrame:
    """Classified lines with ``para``: the line number at which the paragraph that holds a line starts.

    A line starts a paragraph if no other rule takes it (A); it breaks one if it is blank, a
    fence, a heading, a list, quote or table mark, or a semantic prefix (B). A line that is
    neither goes on with the paragraph before it, if one is open.
    """
    x = F.col("line")
    starts = F.col("kind") == "paragraph"
    breaks = (
        F.col("kind").isin("blank", "fence", "code") | x.rlike(r"^#{1,6}\s") | x.rlike(r"^(?:- |\* |> |```|\|)") | x.rlike(r"^\d+\.\s") | x.rlike(L.STOP_PARAGRAPH)
    )
    marked = lines.withColumns({"_a": starts, "_b": breaks})
    last_break = F.coalesce(F.max(F.when(F.col("_b"), F.col("line_no"))).over(_so_far()), F.lit(-1))
    last_start = F.max(F.when(F.col("_a"), F.col("line_no"))).over(_so_far())
    marked = marked.withColumn("_open", F.coalesce(last_start >= last_break, F.lit(False)))
    first = F.col("_a") & (F.col("_b") | ~F.coalesce(F.lag("_open").over(_doc()), F.lit(False)))
    marked = marked.withColumn("_first", first)
    para = F.when(F.col("_open"), F.max(F.when(F.col("_first"), F.col("line_no"))).over(_so_far()))
    return marked.withColumn("para", para).drop("_a", "_b", "_open", "_first")


def _runs(lines: DataFrame, kind: str) -> DataFrame:
    """Islands of neighbouring lines of a kind; fenced lines do not part them."""
    outside = lines.where(~F.col("kind").isin("fence", "code"))
    flag = F.col("kind") == kind
    island = F.sum((~flag).cast("int")).over(_so_far())
    flush = F.min(F.when(~flag, F.col("line_no"))).over(_doc().rowsBetween(1, Window.unboundedFollowing))
    return outside.withColumns({"island": island, "flush": flush}).where(flag)


def list_items(lines: DataFrame) -> DataFrame:
    """(doc_id, island, line_no, item, flush) of list runs."""
    return _runs(lines, "list").withColumn("item", F.regexp_replace("line", r"^[-*\d.]+\s+", "")).select("doc_id", "island", "line_no", "item", "flush")


def table_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, island, line_no, row, flush) of table runs without separator rows."""
    return _runs(lines, "table").where(~F.col("line").rlike(L.SEPARATOR)).select("doc_id", "island", "line_no", F.col("line").alias("row"), "flush")


def _joined(x: str, sep: str) -> Column:
    """Values of a group in line order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(x).alias("x")))), lambda y: y["x"]), sep)


def _indent(x: Column) -> Column:
    """Columns that leading white space takes; a tab goes on to the next multiple of four."""
    return F.aggregate(F.split(x, ""), F.lit(0), lambda at, c: F.when(c == "", at).when(c == "\t", (F.floor(at / 4).cast("int") + 1) * 4).otherwise(at + 1))


def tasks(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, depth, checked, text, parent, tier, root, flush): the task tree as rows; tier is the number of tasks above.

    The parent is the nearest line before, in the same run, with a smaller depth. A task of
    depth d asks for the last line of each smaller depth: d rows, fewer than the characters
    of its indent, however deep. Of these last lines those are above the task that stand behind
    the ones of all smaller depths. A chain of nearest smaller depths ends at the run's last
    line without a parent, so the root is found by their running maximum.
    """
    own = _runs(lines, "task")
    own = own.withColumns({"depth": F.floor(_indent(F.regexp_extract("raw", L.TASK, 1)) / 2).cast("int"), "checked": F.lower(F.regexp_extract("raw", L.TASK, 2)) == "x", "text": strip(F.regexp_extract("raw", L.TASK, 3))})
    asked = own.select("doc_id", "island", "line_no", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"), "depth")
    before = Window.partitionBy("doc_id", "island", "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at_level = asked.withColumn("last", F.max(F.when(F.col("level") == F.col("depth"), F.col("line_no"))).over(before))
    above = F.transform(F.array_sort(F.collect_list(F.struct("level", "last"))), lambda x: x["last"])
    higher = lambda acc, x: F.when(x > acc["at"], F.struct(x.alias("at"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    tier = F.aggregate(above, F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n")), higher, lambda acc: acc["n"])
    parents = at_level.where("level < depth").groupBy("doc_id", "line_no").agg(F.max("last").alias("parent"), tier.alias("tier"))
    own = own.join(parents, ["doc_id", "line_no"], "left")
    w = Window.partitionBy("doc_id", "island").orderBy("line_no")
    root = F.max(F.when(F.col("parent").isNull(), F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("doc_id", "line_no", "depth", "checked", "text", "parent", F.coalesce("tier", F.lit(0)).alias("tier"), root.alias("root"), "flush")


def _single(lines: DataFrame) -> DataFrame:
    """Blocks of one line: headings, images with their captions, quotes and the semantic lines."""
    x = F.col("line")
    nexts = {f"n{k}": F.lead("line", k).over(_doc()) for k in (1, 2)}
    own = lines.withColumns(nexts).where(F.col("para").isNull())
    caption = F.when(F.col("n1").rlike(L.CAPTION), F.regexp_extract("n1", L.CAPTION, 1)).when((F.col("n1") == "") & F.col("n2").rlike(L.CAPTION), F.regexp_extract("n2", L.CAPTION, 1))
    level = F.length(F.regexp_extract(x, L.HEADING, 1))
    name = strip(F.regexp_extract(x, L.HEADING, 2))
    kind = F.when((F.col("kind") == "heading") & (level >= 3) & looks_like_entity(name), "entity").otherwise(F.col("kind"))

    def first_group(patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(x.rlike(p), F.regexp_extract(x, p, 1)) for p in patterns])

    content = (
        F.when(F.col("kind") == "heading", name).when(F.col("kind") == "image", F.regexp_extract(x, L.IMAGE, 1)).when(F.col("kind") == "quote", strip(F.substr(x, F.lit(3))))
        .when(F.col("kind") == "callout", strip(first_group(L.CALLOUTS))).when(F.col("kind") == "warning", strip(first_group(L.WARNINGS))).otherwise(x)
    )
    out = own.where(F.col("kind").isin("heading", "image", "divider", "quote", "callout", "warning", "relationship", "timeline_event", "definition"))
    src = F.when(F.col("kind") == "image", F.regexp_extract(x, L.IMAGE, 2))
    return out.select("doc_id", (F.col("line_no") * 2).alias("at"), kind.alias("type"), F.when(F.col("kind") == "heading", level).otherwise(0).alias("level"), content.alias("content"), src.alias("src"), F.when(F.col("kind") == "image", caption).alias("caption"))


def without_captions(lines: DataFrame) -> DataFrame:
    """Classified lines in which a line that is an image's caption counts as blank."""
    def image(k: int) -> Column:
        return F.lag("kind", k).over(_doc()) == "image"

    is_caption = F.col("line").rlike(L.CAPTION) & (image(1) | (image(2) & (F.lag("line", 1).over(_doc()) == "")))
    return lines.withColumn("_c", F.coalesce(is_caption, F.lit(False))).withColumn("kind", F.when(F.col("_c"), "blank").otherwise(F.col("kind"))).withColumn("text", F.col("line")).drop("_c")


def parse(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, block_id, type, level, content, src, caption): all blocks in document order.

    A run of list, table or task lines is given out where it ends, code where its fence closes;
    an unclosed fence gives nothing.
    """
    marked = paragraphs(without_captions(L.classify(lines)).withColumn("line", F.when((F.col("kind") == "blank"), "").otherwise(F.col("line"))))
    # captions need the original text of the next lines
    single = _single(marked.withColumn("line", F.col("text")))
    none = F.lit(None).cast("string")
    last = F.lit(1 << 30)

    def block(df: DataFrame, at: Column, kind: str, content: str, tie: Column | None = None) -> DataFrame:
        tie = F.lit(0) if tie is None else tie
        return df.select("doc_id", at.cast("int").alias("at"), F.lit(kind).alias("type"), F.lit(0).alias("level"), F.col(content).alias("content"), none.alias("src"), none.alias("caption"), tie.cast("int").alias("tie"))

    paras = marked.where(F.col("para").isNotNull()).groupBy("doc_id", "para").agg(_joined("line", " ").alias("content"))
    lists = list_items(marked).groupBy("doc_id", "island", "flush").agg(_joined("item", "\n").alias("content"))
    tables = table_rows(marked).groupBy("doc_id", "island", "flush").agg(_joined("row", "\n").alias("content"))
    done = tasks(marked).where("parent IS NULL")
    code = marked.where("in_code OR (is_fence AND fence % 2 = 0)").withColumn("block", F.floor((F.col("fence") + 1) / 2).cast("int")).withColumn("block", F.when(F.col("is_fence"), F.floor(F.col("fence") / 2).cast("int")).otherwise(F.col("block")))
    codes = code.groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in_code"), F.struct("line_no", "raw")))), lambda y: y["raw"]), "\n").alias("content"), F.max(F.when(F.col("is_fence"), F.col("line_no"))).alias("closed")).where("closed IS NOT NULL")
    out = single.withColumn("tie", F.lit(0))
    for df in (
        block(paras, F.col("para") * 2, "paragraph", "content"),
        block(done, F.coalesce(F.col("flush") * 2 - 1, last), "task", "text", F.col("line_no")),
        block(lists, F.coalesce(F.col("flush") * 2 - 1, last + 1), "list", "content"),
        block(tables, F.coalesce(F.col("flush") * 2 - 1, last + 2), "table", "content"),
        block(codes, F.col("closed") * 2, "code", "content"),
    ):
        out = out.unionByName(df)
    w = Window.partitionBy("doc_id").orderBy("at", "tie")
    out = out.withColumn("seq", F.row_number().over(w) - 1)
    return out.select("doc_id", "seq", F.format_string("b%04d", F.col("seq") + 1).alias("block_id"), "type", "level", "content", "src", "caption")


def retype(blocks: DataFrame) -> DataFrame:
    """Blocks with the types of the structure step."""
    t = strip(F.col("content"))
    para = (
        F.when(t.rlike(r"(?i)\*\*(?:Important|Critical|Key Rule|Warning|Note|Danger|Alert)\*\*"), F.when(t.rlike(r"(?i)\b(?:warning|danger|alert)\b"), "warning").otherwise("callout"))
        .when(t.rlike(r"(?i)^(?:Warning|Danger|Alert)\s*[:\-]"), "warning").when(t.rlike(r"(?i)^(?:Important|Critical|Key Rule|Note)\s*[:\-]"), "callout")
        .when(t.rlike(r"(?i)^(?:Relationship|Allied with|Enemy of|Mentor to|Rival of|Friend of)"), "relationship").when(t.rlike(r"^(?:Year\s+\d{3,4}|\d{4})\b") | t.rlike(r"^\d{4}\s*[:\-]"), "timeline_event")
        .when(t.rlike(r"(?i)^(?:Definition|Term|Glossary)\s*[:\-]"), "definition").when(t.rlike(r"(?i)^(?:See also|Reference|Source|Cf\.)\s*[:\-]"), "reference").otherwise("paragraph")
    )
    kind = F.when(F.col("type") == "paragraph", para).when((F.col("type") == "heading") & (F.col("level") >= 3) & looks_like_name(F.col("content")), "entity").otherwise(F.col("type"))
    return blocks.withColumn("type", kind)


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with sec (ordinal of the level-1 section, 0 before any) and sub (ordinal within it, 0 before any)."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    h1 = ((F.col("type") == "heading") & (F.col("level") == 1)).cast("int")
    h2 = ((F.col("type") == "heading") & (F.col("level") == 2)).cast("int")
    own = blocks.withColumn("sec", F.sum(h1).over(w)).withColumn("_h2", h2)
    inner = Window.partitionBy("doc_id", "sec").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("sub", F.sum("_h2").over(inner)).drop("_h2")


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): the blocks written back."""
    c = F.col("content")
    image = F.concat(F.lit("!["), c, F.lit("]("), F.coalesce("src", F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit("\n*"), F.col("caption"), F.lit("*")), F.lit("")))
    text = (
        F.when(F.col("type").isin("heading", "entity"), F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), c))
        .when(F.col("type") == "quote", F.concat(F.lit("> "), c)).when(F.col("type") == "code", F.concat(F.lit("```\n"), c, F.lit("\n```"))).when(F.col("type") == "divider", "---")
        .when(F.col("type") == "image", image).otherwise(c)
    )
    rows = blocks.select("doc_id", "seq", text.alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda y: y["x"]), "\n\n").alias("markdown"))
