"""Text against lexicons: hits, genre scores, winners, blends, modifiers and moods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from foliant.functions.color import hue_mean
from foliant.functions.text import count_of, word_count

MAX_LISTED = 100_000  # entries of a lexicon that may be broadcast


def _checked(lexicon: DataFrame) -> DataFrame:
    """A lexicon is broadcast only if its size is known to be small."""
    return F.broadcast(lexicon) if lexicon.limit(MAX_LISTED + 1).count() <= MAX_LISTED else lexicon


def _listed(lexicon: DataFrame) -> list[Row]:
    """All entries in order; a lexicon of more than MAX_LISTED is refused, as it would be cut otherwise."""
    rows = lexicon.orderBy("ord").limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        raise ValueError(f"the lexicon has more than MAX_LISTED={MAX_LISTED} entries")
    return rows


def phrase_hits(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, ord, key, hits): the sum of non-overlapping counts of each entry's signals, for every entry.

    The lexicon becomes one array literal of bounded size, so a text is read once and no join is made.
    """
    entries = _listed(lexicon)
    x = F.lower(F.coalesce(F.col("text"), F.lit("")))
    scored = F.array(*[F.struct(F.lit(e["ord"]).alias("ord"), F.lit(e["key"]).alias("key"), sum((count_of(F.col("x"), F.lit(s)) for s in e["signals"]), F.lit(0)).alias("hits")) for e in entries])
    return texts.select("doc_id", x.alias("x")).select("doc_id", F.explode(scored).alias("e")).select("doc_id", "e.*")


def length_factor(words: Column, cap: bool) -> Column:
    """Three hundred words make one unit, 0.3 at least and, if capped, 20 at most."""
    units = words / 300
    return F.greatest(F.least(units, F.lit(20.0)) if cap else units, F.lit(0.3))


def genre_scores(texts: DataFrame, lexicon: DataFrame, cap: bool = True) -> DataFrame:
    """(doc_id, ord, key, score): hits over the length factor, two decimals."""
    size = texts.select("doc_id", length_factor(F.greatest(word_count(F.coalesce(F.col("text"), F.lit(""))), F.lit(1)), cap).alias("unit"))
    return phrase_hits(texts, lexicon).join(size, "doc_id").select("doc_id", "ord", "key", F.round(F.col("hits") / F.col("unit"), 2).alias("score"))


def genre_pick(scores: DataFrame, least: float = 1.2, promote: float = 0.85, hybrid: float = 0.55) -> DataFrame:
    """(doc_id, genre, score, runner, runner_score): the winner and, if close enough, one of another parent.

    A bare parent that wins gives way to its best subgenre of at least 0.85 of its score.
    """
    parent = F.substring_index("key", "/", 1)
    own = scores.withColumn("parent", parent)
    order = F.struct("score", (-F.col("ord")).alias("o"))
    best = own.groupBy("doc_id").agg(F.max_by(F.struct("key", "score", "parent"), order).alias("b"))
    with_best = own.join(best, "doc_id")
    sub = with_best.where((F.col("b.key") == F.col("b.parent")) & (F.col("parent") == F.col("b.parent")) & (F.col("key") != F.col("b.key")) & (F.col("score") >= F.col("b.score") * promote))
    sub = sub.groupBy("doc_id").agg(F.max_by(F.struct("key", "score"), order).alias("s"))
    runner = with_best.where(F.col("parent") != F.col("b.parent")).groupBy("doc_id").agg(F.max_by(F.struct("key", "score"), order).alias("r"))
    out = best.join(sub, "doc_id", "left").join(runner, "doc_id", "left")
    enough = F.col("b.score") >= least
    score = F.coalesce("s.score", "b.score")
    close = enough & (F.col("r.score") >= score * hybrid) & (F.col("r.score") > 0)
    return out.select(
        "doc_id",
        F.when(enough, F.coalesce("s.key", "b.key")).otherwise("neutral").alias("genre"),
        score.alias("score"),
        F.when(close, F.col("r.key")).alias("runner"),
        F.when(close, F.col("r.score")).alias("runner_score"),
    )


def genre_blend(picked: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, label, hue, sat, energy, body_font): the style of winner and runner, weighted by score."""
    one = _checked(lexicon.select(F.col("key").alias("genre"), F.col("hue").alias("h1"), F.col("sat").alias("s1"), F.col("energy").alias("e1"), F.col("body_font").alias("f1")))
    two = _checked(lexicon.select(F.col("key").alias("runner"), F.col("hue").alias("h2"), F.col("sat").alias("s2"), F.col("energy").alias("e2"), F.col("body_font").alias("f2")))
    own = picked.where("genre <> 'neutral'").join(one, "genre").join(two, "runner", "left")
    w2 = F.coalesce(F.col("runner_score") / (F.col("score") + F.col("runner_score")), F.lit(0.0))
    mix = lambda a, b: F.col(a) * (1 - w2) + F.coalesce(b, a) * w2
    return own.select(
        "doc_id",
        F.when(w2 >= 0.32, F.concat_ws(" + ", "genre", "runner")).otherwise(F.col("genre")).alias("label"),
        F.when(w2 > 0, hue_mean(F.col("h1"), F.coalesce("h2", "h1"), w2)).otherwise(F.col("h1")).alias("hue"),
        mix("s1", "s2").alias("sat"),
        mix("e1", "e2").alias("energy"),
        F.when(w2 >= 0.38, F.col("f2")).otherwise(F.col("f1")).alias("body_font"),
    )


def first_best(scores: DataFrame, least: float) -> DataFrame:
    """(doc_id, key, score): the best entry, the first among equals, if it reaches a limit."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord")
    return scores.withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) & (F.col("score") >= least)).select("doc_id", "key", "score")


def is_food(texts: DataFrame, words: tuple[str, ...], moods: DataFrame) -> DataFrame:
    """(doc_id, food): enough cooking words for the text's length, or a mood with them."""
    x = F.lower(F.coalesce(F.col("text"), F.lit("")))
    own = texts.select("doc_id", sum((count_of(x, F.lit(s)) for s in words), F.lit(0)).alias("mechanics"), word_count(x).alias("n"), x.alias("x"))
    listed = _listed(moods)
    best = F.greatest(F.lit(0), *[sum((F.contains(F.col("x"), F.lit(s)).cast("int") for s in e["signals"]), F.lit(0)) for e in listed])
    own = own.withColumn("mood", best)
    hits = F.col("mechanics") + F.col("mood")
    enough = (hits >= 2) & ((F.col("mechanics") >= 2) | (F.col("mood") >= 2) | ((F.col("mood") >= 1) & (F.col("mechanics") >= 1)))
    return own.select("doc_id", (enough & (hits / F.greatest(F.greatest(F.col("n"), F.lit(1)) / 300, F.lit(0.3)) >= 2.2)).alias("food"))
