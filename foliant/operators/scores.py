"""Term statistics, importance, project types and suggestions over typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import count_of, tokens

# fixed values: words that term statistics leave out
STOP_WORDS = (
    "the and for are but not you all can her was one our out day get has him his how its may new now old see two who boy did let put say she too use that this with have from they will been when your what said "
    "each which their time into than then some these would there more also after where about other were well"
).split()
# fixed values: words of importance and base scores of block types
HIGH = ("important", "critical", "warning", "key rule", "crucial", "essential", "must", "never", "always", "required", "forbidden", "prohibited", "core", "fundamental", "primary", "main", "central")
MEDIUM = ("note", "remember", "significant", "notable", "relevant", "major", "secondary", "key", "special", "unique")
BASE = {
    "warning": 85, "callout": 75, "entity": 65, "relationship": 60, "timeline_event": 55, "definition": 50, "heading": 45, "table": 45, "quote": 40, "task": 40, "list": 35, "code": 30, "reference": 30,
    "paragraph": 25, "image": 20, "divider": 5,
}
# fixed values: signals of project types, in order of precedence
PROJECTS = {
    "Story Bible": "character protagonist antagonist world magic kingdom chapter plot narrative lore faction race realm prophecy quest hero villain backstory",
    "Research Notes": "hypothesis methodology findings data analysis study experiment results citation source abstract conclusion bibliography literature research evidence",
    "Project Plan": "milestone deadline sprint deliverable stakeholder scope timeline budget resource task objective kpi roadmap requirement risk dependency",
    "Worldbuilding Document": "geography culture religion economy government history language technology map region continent civilization species mythology cosmology",
    "Knowledge Base": "definition concept overview reference documentation guide tutorial faq glossary specification standard",
    "Study Notes": "formula theorem proof lecture exam quiz review chapter topic concept summary flashcard note",
    "Debate Preparation": "debate motion resolution rebuttal argument counterargument affirmative negative contention burden_of_proof cross-examination case framework impact clash evidence",
    "Competition Planning": "competition contest tournament bracket entry submission judging criteria prize eligibility registration rules scoring round finalist qualifier",
}
SUGGESTIONS = {
    "Story Bible": ("codex", "manuscript", "noir"), "Worldbuilding Document": ("codex", "noir", "magazine"), "Research Notes": ("scientific", "academic", "minimalist"),
    "Project Plan": ("corporate", "startup", "academic"), "Knowledge Base": ("academic", "scientific", "minimalist"), "Study Notes": ("academic", "scientific", "newspaper"),
    "Debate Preparation": ("corporate", "newspaper", "detective"), "Document": ("academic", "minimalist", "magazine"), "Competition Planning": ("academic", "magazine"),
}


def signals() -> list[tuple[int, str, str, bool]]:
    """(ordinal, project type, signal, whether it is matched as a phrase)."""
    return [(k, p, s.replace("_", " "), "_" in s or "-" in s) for k, (p, ss) in enumerate(PROJECTS.items()) for s in ss.split()]


def term_frequency(texts: DataFrame) -> DataFrame:
    """(doc_id, word, n) of lower-case words of three letters or more, without stop words; texts has doc_id and content."""
    own = texts.select("doc_id", F.explode(tokens(F.coalesce("content", F.lit("")), 3)).alias("word"))
    return own.where(~F.col("word").isin(*STOP_WORDS)).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def top_terms(freq: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent words of each document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return freq.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _contains_any(x: Column, names: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda k: F.contains(x, k))


def keyword_flags(blocks: DataFrame) -> DataFrame:
    x = F.lower("content")
    return blocks.select("doc_id", "seq", _contains_any(x, HIGH).alias("high"), _contains_any(x, MEDIUM).alias("medium"))


def importance(blocks: DataFrame) -> DataFrame:
    """Blocks with importance, 0..100.

    The document's word counts and entity names meet the blocks in equi-joins by document:
    words are exploded, looked up and averaged again by block, so nothing is collected.
    """
    x = F.lower("content")
    freq = term_frequency(blocks)
    long = blocks.select("doc_id", "seq", F.explode(tokens(F.col("content"), 4)).alias("word")).join(freq, ["doc_id", "word"], "left")
    fame = long.groupBy("doc_id", "seq").agg(F.avg(F.coalesce("n", F.lit(0))).alias("fame"))
    names = blocks.where("type = 'entity'").select("doc_id", F.lower("content").alias("name")).distinct()
    named = blocks.select("doc_id", "seq", x.alias("x")).join(names.where(F.length("name") > 3), "doc_id").where(F.contains("x", F.col("name")))
    mentions = named.groupBy("doc_id", "seq").agg(F.count("*").alias("mentions"))
    refs = names.join(freq, (names.doc_id == freq.doc_id) & (names.name == freq.word)).select(names.doc_id, "name", F.col("n").alias("refs"))
    own = blocks.withColumn("name", F.when(F.col("type") == "entity", x)).join(fame, ["doc_id", "seq"], "left").join(mentions, ["doc_id", "seq"], "left").join(refs, ["doc_id", "name"], "left").drop("name")
    w = Window.partitionBy("doc_id")
    place = (F.row_number().over(w.orderBy("seq")) - 1) / F.count("*").over(w)
    base = F.create_map(*[F.lit(v) for kv in BASE.items() for v in kv])
    boost = F.least(_contains_any(x, HIGH).cast("int") * 15 + _contains_any(x, MEDIUM).cast("int") * 7, F.lit(20))
    bold = F.when(F.col("content").rlike(r"(?i)\*\*(?:Important|Critical|Warning|Key Rule)\*\*"), 18).otherwise(0)
    level = F.when(F.col("type") == "heading", F.greatest((4 - F.col("level")) * 8, F.lit(0))).otherwise(0)
    score = F.coalesce(base[F.col("type")], F.lit(25)) + boost + bold + F.when(place < 0.1, 10).when(place < 0.2, 5).otherwise(0) + level
    score = score + F.least(F.coalesce("refs", F.lit(0)) * 5, F.lit(25)) + F.least(F.coalesce("mentions", F.lit(0)) * 3, F.lit(12)) + F.least(F.coalesce("fame", F.lit(0.0)) * 2, F.lit(10.0))
    return own.withColumn("importance", F.least(F.round(score, 1), F.lit(100.0))).drop("fame", "mentions", "refs")


def project_scores(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, project, score) for every document and type.

    Words are counted once per document and looked up in the signals, which are a fixed list
    of some 120 words; phrases are counted as substrings.
    """
    spark: SparkSession = blocks.sparkSession
    listed = F.broadcast(spark.createDataFrame(signals(), "ord int, project string, signal string, phrase boolean"))
    own = blocks.select("doc_id", F.explode(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+")).alias("signal"))
    single = own.groupBy("doc_id", "signal").agg(F.count("*").alias("n")).join(listed.where("NOT phrase"), "signal").groupBy("doc_id", "ord").agg(F.sum("n").alias("n"))
    text = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.lower("content").alias("x")))), lambda y: y["x"]), " ").alias("x"))
    phrases = [(k, s) for k, _, s, phrase in signals() if phrase]
    counted = text.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), (count_of(F.col("x"), F.lit(s)) * 3).alias("n")) for k, s in phrases])).alias("p")).select("doc_id", "p.ord", "p.n")
    counts = blocks.groupBy("doc_id").agg(*[F.count_if(F.col("type") == t).alias(a) for t, a in (("entity", "e"), ("timeline_event", "t"), ("relationship", "r"))])
    grid = counts.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("project")) for k, p in enumerate(PROJECTS)])).alias("g")).select("doc_id", "g.*", "e", "t", "r")
    found = single.unionByName(counted).groupBy("doc_id", "ord").agg(F.sum("n").alias("n"))
    e = F.when(F.col("e") > 3, F.col("e")).otherwise(0)
    t = F.when(F.col("t") > 2, F.col("t")).otherwise(0)
    r = F.when(F.col("r") > 1, F.col("r")).otherwise(0)
    bonus = F.when(F.col("ord") == 0, e * 3 + t * 2 + r * 3).when(F.col("ord") == 3, e * 2).when(F.col("ord") == 2, t * 2).otherwise(0)
    return grid.join(found, ["doc_id", "ord"], "left").select("doc_id", "ord", "project", (F.coalesce("n", F.lit(0)) + bonus).alias("score"))


def project_type(scores: DataFrame) -> DataFrame:
    """(doc_id, project, confidence): the best type, if there is evidence enough."""
    own = scores.groupBy("doc_id").agg(F.max_by("project", F.struct("score", -F.col("ord"))).alias("best"), F.max("score").alias("top"), F.sum("score").alias("total"))
    enough = F.col("total") >= 6
    return own.select("doc_id", F.when(enough, F.col("best")).otherwise("Document").alias("project"), F.when(enough, F.least(F.round(F.col("top") * 100 / F.col("total"), 1), F.lit(95.0))).otherwise(0.0).alias("confidence"))


def suggestions(types: DataFrame) -> DataFrame:
    """(doc_id, place, theme, confidence): up to three themes of each document's type."""
    themes = F.create_map(*[x for p, ts in SUGGESTIONS.items() for x in (F.lit(p), F.array(*map(F.lit, ts)))])
    own = types.select("doc_id", "confidence", F.posexplode(themes[F.col("project")]).alias("place", "theme"))
    return own.select("doc_id", "place", "theme", F.greatest(F.col("confidence") - F.col("place") * 15, F.lit(20.0)).alias("confidence"))


def is_manuscript(blocks: DataFrame) -> DataFrame:
    """(doc_id, manuscript): at least 20 blocks, over 90 % of them prose."""
    share = F.avg(F.col("type").isin("paragraph", "heading", "quote", "divider").cast("int"))
    return blocks.groupBy("doc_id").agg(((F.count("*") >= 20) & (share > 0.9)).alias("manuscript"))


def entity_descriptions(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """(doc_id, seq, name, description): the first paragraph or quote among the next blocks of each entity."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, reach)
    prose = F.when(F.col("type").isin("paragraph", "quote"), F.col("content"))
    own = blocks.withColumn("description", F.first(prose, ignorenulls=True).over(w))
    return own.where("type = 'entity'").select("doc_id", "seq", F.col("content").alias("name"), "description")
