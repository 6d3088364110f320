"""Theme tables: built-in ids, custom themes as JSON files, saving and union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import safe_name
from foliant.sources.store import Store, read_json

# fixed values: ids and names of the built-in themes
BUILTIN = (
    ("academic", "Academic"), ("codex", "Codex"), ("corporate", "Corporate"), ("detective", "Detective"), ("magazine", "Magazine"), ("manuscript", "Manuscript"), ("minimalist", "Minimalist"), ("museum", "Museum"),
    ("newspaper", "Newspaper"), ("noir", "Noir"), ("research", "Research"), ("scientific", "Scientific"), ("startup", "Startup"),
)
SCHEMA = "id string, name string, description string, icon string, properties map<string,string>, elements map<string,struct<fg:string,bg:string>>"


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, "builtin") for i, n in BUILTIN], "id string, name string, origin string")


def with_custom(builtins: DataFrame, custom: DataFrame) -> DataFrame:
    """Both; a custom theme stands in for a built-in one of its id."""
    return custom.unionByName(builtins.join(F.broadcast(custom.select("id")), "id", "left_anti") if custom.limit(100_001).count() <= 100_000 else builtins.join(custom.select("id"), "id", "left_anti"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Custom themes of a folder, one JSON file each, with ``path`` and ``unreadable``: the text of a file that is no theme, all else null."""
    return read_json(spark, folder, SCHEMA)


def store(spark: SparkSession, root: str) -> Store:
    """Custom themes as a versioned table; an id is kept as a file's name would be."""
    return Store(spark, root, SCHEMA)


def save(themes: Store, rows: DataFrame) -> int:
    """Set themes; a theme that is saved again replaces its older version."""
    return themes.save(rows.withColumn("id", safe_name(F.col("id"))))
