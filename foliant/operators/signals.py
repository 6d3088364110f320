"""Lexicons of any size: texts against tables of signals with an automaton per shard, and sparse scores.

A signal table has (ord, key, signal, whole, weight): entry number and key, the phrase, whether it counts as a
whole word only, and what a hit is worth. It is dealt into shards of about ``shard_bytes`` of phrases;
each shard is one automaton that a worker builds once, so a text is scanned once for each
shard, whatever the number of phrases in it. Only entries that are hit give rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import word_count
from foliant.operators import lexicon as L

SHARD_BYTES = 16 << 20

# fixed values: the entry whose signals are whole words, the one that the atmosphere's signals count for, and their worth
WHOLE_WORDS = ("historical/classic_literature",)
ATMOSPHERE_KEY, ATMOSPHERE_WEIGHT = "horror_gothic", 0.8
# fixed values: moods of food
DEFAULT_MOOD, LEAST_MOOD, MOOD_RUNNER, LEAST_RUNNER = "home_cooking", 0.8, 0.6, 0.5


def signal_table(lexicon: DataFrame, whole_keys: tuple[str, ...] = WHOLE_WORDS, atmosphere: DataFrame | None = None, atmosphere_key: str = ATMOSPHERE_KEY) -> DataFrame:
    """The signals of a lexicon (ord, key, signals); those of an atmosphere (signal) count for one entry beside its own."""
    own = lexicon.select("ord", "key", F.explode("signals").alias("signal"), F.col("key").isin(*whole_keys).alias("whole"), F.lit(1.0).alias("weight"))
    if atmosphere is not None:
        entry = lexicon.where(F.col("key") == atmosphere_key).select("ord", "key", F.lit(False).alias("whole"), F.lit(ATMOSPHERE_WEIGHT).alias("weight"), F.lit(1).alias("_on"))
        extra = atmosphere.select("signal", F.lit(1).alias("_on")).join(entry, "_on").drop("_on")
        own = own.unionByName(extra)
    return own.where("signal <> ''")


def _wordlike(c: str) -> bool:
    return c.isalnum() or c == "_"


def is_border(text: str, at: int) -> bool:
    """Whether a word starts or ends before this place."""
    return (at > 0 and _wordlike(text[at - 1])) != (at < len(text) and _wordlike(text[at]))


def _counts(machine, text: str) -> Counter:
    """Counts of (signal, whole): matches of one signal do not overlap, the leftmost count."""
    ends: dict[tuple[str, bool], int] = {}
    found: Counter = Counter()
    for end, (signal, kinds) in machine.iter(text):
        start = end + 1 - len(signal)
        for whole in kinds:
            if start >= ends.get((signal, whole), 0) and (not whole or (is_border(text, start) and is_border(text, end + 1))):
                ends[signal, whole] = end + 1
                found[signal, whole] += 1
    return found


def _shards(signals: DataFrame, shard_bytes: int) -> Iterator[list[tuple]]:
    """The distinct phrases with their owners, so many bytes at a time."""
    size = signals.agg(F.sum(F.octet_length("signal"))).first()[0] or 0
    n = -(-size // shard_bytes)
    for k in range(n):
        part = signals.where(F.pmod(F.xxhash64("signal"), F.lit(n)) == k)
        shard = [tuple(r) for r in part.select("ord", "key", "signal", "whole", "weight").collect()]
        if shard:
            yield shard


def _scan(texts: DataFrame, shard: list[tuple]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        owners: dict[tuple[str, bool], list[tuple[int, str, float]]] = {}
        kinds: dict[str, set[bool]] = {}
        for k, key, signal, whole, weight in shard:
            owners.setdefault((signal, whole), []).append((k, key, weight))
            kinds.setdefault(signal, set()).add(whole)
        machine = ahocorasick.Automaton()
        for signal, own in kinds.items():
            machine.add_word(signal, (signal, tuple(own)))
        machine.make_automaton()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits: Counter = Counter()
                for signal, n in _counts(machine, (text or "").lower()).items():
                    for owner in owners[signal]:
                        hits[owner] += n
                rows += [(doc, *owner, n) for owner, n in hits.items()]
            if rows:
                kinds_of = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64())
                names = ("doc_id", "ord", "key", "weight", "hits")
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), kinds_of, strict=True)})

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, ord int, key string, weight double, hits long")


def hits(texts: DataFrame, signals: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, ord, key, weight, hits) of the entries that a text hits."""
    parts = [_scan(texts, shard) for shard in _shards(signals, shard_bytes)]
    if not parts:
        return texts.select("doc_id", F.lit(0).alias("ord"), F.lit("").alias("key"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("hits")).where("false")
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "ord", "key", "weight").agg(F.sum("hits").alias("hits"))


def scores(texts: DataFrame, signals: DataFrame, cap: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, ord, key, score) of the entries that a text hits: worth of the hits over the length factor, two decimals."""
    worth = F.sum(F.when(F.col("weight") == 1, F.col("hits")).otherwise(0)) + F.sum(F.when(F.col("weight") != 1, F.col("hits") * F.col("weight")).otherwise(0.0))
    own = hits(texts, signals, shard_bytes).groupBy("doc_id", "ord", "key").agg(worth.alias("worth"))
    unit = texts.select("doc_id", L.length_factor(F.greatest(word_count(F.coalesce(F.col("text"), F.lit(""))), F.lit(1)), cap).alias("unit"))
    return own.join(unit, "doc_id").select("doc_id", "ord", "key", F.round(F.col("worth") / F.col("unit"), 2).alias("score"))


def genres(texts: DataFrame, scored: DataFrame) -> DataFrame:
    """(doc_id, genre, score, runner, runner_score) of every text; one without any hit is neutral."""
    own = texts.select("doc_id").join(L.genre_pick(scored), "doc_id", "left")
    return own.select("doc_id", F.coalesce("genre", F.lit("neutral")).alias("genre"), F.coalesce("score", F.lit(0.0)).alias("score"), "runner", "runner_score")


def is_food(texts: DataFrame, mechanics: DataFrame, moods: DataFrame) -> DataFrame:
    """(doc_id, food): two or more cooking words and mood signals, not scattered ones alone, and enough for the length.

    Mood signals count once each, over all moods; they are evidence where one mood has two of them, or one beside a cooking word.
    """
    cooking = hits(texts, mechanics).groupBy("doc_id").agg(F.sum("hits").alias("cooking"))
    present = hits(texts, moods.withColumn("ord", F.xxhash64("key", "signal").bitwiseAND(0x7FFFFFFF).cast("int")))
    by_mood = present.groupBy("doc_id", "key").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("best"), F.sum("n").alias("total"))
    unit = texts.select("doc_id", L.length_factor(word_count(F.coalesce(F.col("text"), F.lit(""))), False).alias("unit"))
    own = unit.join(cooking, "doc_id", "left").join(by_mood, "doc_id", "left").fillna(0, ["cooking", "best", "total"])
    evidence = (F.col("cooking") >= 2) | (F.col("best") >= 2) | ((F.col("best") >= 1) & (F.col("cooking") >= 1))
    found = F.col("cooking") + F.col("total")
    return own.select("doc_id", ((found >= 2) & evidence & (found / F.col("unit") >= 2.2)).alias("food"))


def food_moods(texts: DataFrame, scored: DataFrame) -> DataFrame:
    """(doc_id, mood, score, runner, runner_score): the best mood, the default one below a limit, and a runner-up close enough to blend."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "ord", "key", "score")))
    ranked = scored.groupBy("doc_id").agg(order.alias("r"))
    own = texts.select("doc_id").join(ranked, "doc_id", "left")
    at = lambda k, x: F.try_element_at("r", F.lit(k))[x]
    enough = F.coalesce(at(1, "score") >= LEAST_MOOD, F.lit(False))
    close = enough & (at(2, "score") >= at(1, "score") * MOOD_RUNNER) & (at(2, "score") >= LEAST_RUNNER)
    return own.select("doc_id", F.when(enough, at(1, "key")).otherwise(DEFAULT_MOOD).alias("mood"), F.coalesce(at(1, "score"), F.lit(0.0)).alias("score"), F.when(close, at(2, "key")).alias("runner"), F.when(close, at(2, "score")).alias("runner_score"))

