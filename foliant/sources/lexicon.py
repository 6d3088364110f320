"""Lexicons: entries with signals and style values, read from tables or from the seed below.

The seed is small and our own; a full lexicon is loaded with read_lexicon from JSON or
Parquet with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.store import read_json

SCHEMA = "ord int, parent string, key string, signals array<string>, hue double, sat double, energy double, heading_font string, body_font string, decor string"

SEED = (
    ("gothic", "gothic", "there that thin dread night shadow", 280.0, 0.35, 0.80, "Cinzel", "EB Garamond", "ornate"),
    ("gothic", "gothic/manor", "hand on rest hall stair", 290.0, 0.30, 0.70, "Cinzel", "Lora", "ornate"),
    ("voyage", "voyage", "than sea tion iron sail", 200.0, 0.55, 0.45, "Spectral", "Source Serif", "rope"),
    ("voyage", "voyage/harbor", "heed station ration port", 210.0, 0.50, 0.40, "Spectral", "Lora", "rope"),
    ("garden", "garden", "able rent seed ment leaf", 110.0, 0.45, 0.20, "Fraunces", "Nunito", "leaf"),
    ("ledger", "ledger", "ing the count sum und", 30.0, 0.20, 0.15, "Inter", "Inter", "rule"),
    ("ledger", "ledger/audit", "der ein audit sch proof", 20.0, 0.25, 0.25, "Inter", "Inter", "rule"),
)
#: (ord, name, signals, hue shift, saturation factor, energy factor)
MODIFIERS = ((0, "bright", "ness light able", 10.0, 1.2, 0.8), (1, "stark", "not none st", -20.0, 0.6, 1.3), (2, "warm", "fire home her", 15.0, 1.1, 0.9))
FOOD_WORDS = ("rest", "heat", "bread", "stir", "eat", "oven", "salt")
FOOD_MOODS = ((0, "hearth", "heat ten her", 25.0), (1, "market", "sea are for", 140.0), (2, "feast", "great eat and on", 350.0))


def seed_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(k, parent, key, words.split(" "), hue, sat, energy, head, body, decor) for k, (parent, key, words, hue, sat, energy, head, body, decor) in enumerate(SEED)]
    return spark.createDataFrame(rows, SCHEMA)


def read_lexicon(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A lexicon table; of JSON files also ``path`` and ``unreadable``, the text of a file that is no entry."""
    return read_json(spark, path, SCHEMA) if fmt == "json" else spark.read.schema(SCHEMA).format(fmt).load(path)
