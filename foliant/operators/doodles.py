"""Doodles: small icons set beside blocks that hold a word of a vocabulary.

The vocabulary is a table (ord, word, icon) of any size, dealt into shards by bytes. A text gives one row
for each word in it, at its first place as a whole word; these rows, far smaller than the texts,
are sorted by document and place, and one pass over the sorted rows puts the doodles down. The pass keeps a
document's counters alone, so a document of any length needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.signals import SHARD_BYTES, is_border

# fixed values: per density the most doodles of a document, the least distance of blocks and the most per block
PRESETS = {0: (0, 999, 0), 1: (10, 3, 1), 2: (30, 1, 2), 3: (80, 0, 2), 4: (250, 0, 3)}
DEFAULT_DENSITY = 2
# fixed values: types of blocks that take doodles; least and most of size (px), turn (degrees) and opacity (percent)
TYPES = ("paragraph", "heading", "quote")
SIZE, TURN, OPACITY = (18, 58), (-22, 22), (70, 92)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, word, icon) of a JSON-lines file of that shape; words count in lower case, empty ones not at all."""
    own = spark.read.schema("ord int, word string, icon string").json(path)
    return own.select("ord", F.lower("word").alias("word"), "icon").where("word <> '' AND icon <> ''")


def _shards(vocabulary: DataFrame, shard_bytes: int) -> Iterator[list[tuple]]:
    size = vocabulary.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    n = -(-size // shard_bytes)
    for k in range(n):
        shard = [tuple(r) for r in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(n)) == k).select("ord", "word", "icon").collect()]
        if shard:
            yield shard


def _found(blocks: DataFrame, shard: list[tuple]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        icons = {word: (order, word, icon) for order, word, icon in sorted(shard, reverse=True)}
        for word, own in icons.items():
            machine.add_word(word, own)
        machine.make_automaton()
        names, kinds = ("doc_id", "seq", "density", "at", "ord", "word", "icon"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for doc, seq, density, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = set()
                for end, (order, word, icon) in machine.iter(text):
                    start = end + 1 - len(word)
                    if word not in seen and is_border(text, start) and is_border(text, end + 1):
                        seen.add(word)
                        rows.append((doc, seq, density, start, order, word, icon))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return blocks.mapInArrow(run, "doc_id long, seq int, density int, at int, ord int, word string, icon string")


def candidates(blocks: DataFrame, vocabulary: DataFrame, density: Column | int = DEFAULT_DENSITY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, seq, density, at, ord, word, icon): the first place of every word of the vocabulary in every block that takes doodles.

    Of a word that is listed twice the lowest order counts. Blocks without content and documents of density 0 give none.
    """
    level = F.least(F.greatest(F.coalesce(F.lit(density) if isinstance(density, int) else density, F.lit(DEFAULT_DENSITY)), F.lit(0)), F.lit(4)).cast("int")
    own = blocks.where(F.col("type").isin(*TYPES) & (F.col("content") != "")).select(F.col("doc_id").cast("long"), F.col("seq").cast("int"), level.alias("density"), F.lower("content").alias("content")).where("density > 0")
    parts = [_found(own, shard) for shard in _shards(vocabulary, shard_bytes)]
    if not parts:
        return own.select("doc_id", "seq", "density", F.lit(0).alias("at"), F.lit(0).alias("ord"), F.lit("").alias("word"), F.lit("").alias("icon")).where("false")
    return reduce(DataFrame.unionByName, parts)


def placed(found: DataFrame) -> DataFrame:
    """(doc_id, seq, place, word, icon, side): the doodles that candidates get, in page order.

    Blocks keep the least distance to the last one with a doodle; an icon stands once in a block
    and never twice in a row in a document; sides take turns. Caps are the feature: density
    asks for them. Rows of one document and seq count as one block.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = run  # no document yet; null is a document of its own
        most = gap = per_block = n = last = here = 0
        block = before = None
        used: set[str] = set()
        for batch in batches:
            rows = []
            for own, seq, density, word, icon in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != doc:
                    doc, block, before, n, here = own, None, None, 0, 0
                    most, gap, per_block = PRESETS[density]
                    last = -gap
                if seq != block:
                    last = block if here else last
                    block, here = seq, 0
                    used.clear()
                if n < most and here < per_block and seq - last >= gap and icon not in used and icon != before:
                    rows.append((own, seq, here, word, icon, "right" if n % 2 else "left"))
                    used.add(icon)
                    before, n, here = icon, n + 1, here + 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "seq", "place", "word", "icon", "side"])

    ordered = found.repartition("doc_id").sortWithinPartitions("doc_id", "seq", "at", "ord", "word")
    return ordered.select("doc_id", "seq", "density", "word", "icon").mapInArrow(run, "doc_id long, seq int, place int, word string, icon string, side string")


def drawn(doodles: DataFrame) -> DataFrame:
    """The doodles with size, turn and opacity, which hang on word and place alone and so stay when a page is made again."""
    digest = F.crc32(F.concat("word", F.col("seq").cast("string"), F.col("place").cast("string")).cast("binary"))
    within = lambda bounds, shift: F.shiftright(digest, shift) % (bounds[1] - bounds[0] + 1) + bounds[0]
    return doodles.select("*", within(SIZE, 0).cast("int").alias("size"), within(TURN, 8).cast("int").alias("turn"), (within(OPACITY, 16) / 100).alias("opacity"))


def doodles(blocks: DataFrame, vocabulary: DataFrame, density: Column | int = DEFAULT_DENSITY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, seq, place, word, icon, side, size, turn, opacity) of blocks (doc_id, seq, type, content)."""
    return drawn(placed(candidates(blocks, vocabulary, density, shard_bytes)))


def missing(vocabulary: DataFrame, assets: DataFrame) -> DataFrame:
    """(icon): icons of a vocabulary that no asset (icon) has."""
    return vocabulary.select("icon").distinct().join(assets.select("icon").distinct(), "icon", "left_anti")
