"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Each language has a zstandard dictionary of raw content, cut from labelled documents. A text is
folded (lower case, runs of what is no letter become one space) and encoded whole with each
dictionary; the smallest result names the language. The margin is what it saves of the second
smallest. Where that is below ``least_margin`` the answer is marked as rejected: it still
names the nearest language, as a caller may want it, but says that the texts of two languages
explain it about as well.

A dictionary is a bounded sample: a language has ``pieces`` slots, a labelled document falls into
one by a hash of its key, and the document with the smallest hash fills the slot with
``piece_chars`` characters from a hashed place. Slots are minima, so they combine before the
shuffle and a language with a third of all rows costs no more than others. The driver and each
worker hold ``langs_per_block`` dictionaries at a time; where there are more languages, each
further block takes one more pass that carries the best two sizes so far.

Defined results: a null text and one without a letter are ``und`` with score 0; so is every text if
nothing is labelled or there is no column of languages. Null languages teach nothing; the empty
string is a language like others. A row without a key is predicted, but neither learned from nor
held out. Languages with equal sizes: the first by name, with margin and score 0. With one
learned language the margin is 1. Repeated rows are predicted one by one and fill a slot once;
an empty table gives an empty result; texts of any length are taken whole; other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, arrow_map, worker_state

UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and limits of the method.

    ``sharpness`` turns a margin into a score: 1 - exp(-sharpness * margin).
    """

    pieces: int = 128
    piece_chars: int = 1500
    least_margin: float = 0.01
    sharpness: float = 40.0
    langs_per_block: int = 64


_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"\P{L}+")


def folded(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


#: Short matches, as words are short; frames without header fields, as only sizes are compared.
_PARAMETERS = {
    "strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 18, "chain_log": 16, "hash_log": 16, "search_log": 4,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS,
}


class Coder:
    """Compressors of some languages, in the order of their names."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self._coders = []
        for lang in self.langs:
            params = zstandard.ZstdCompressionParameters(**_PARAMETERS)
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self._coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        raw = folded(text)
        return [len(c.compress(raw)) for c in self._coders]


def held_out(key: Column) -> Column:
    """Whether a key's fold is kept from learning; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_pieces(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, slot, piece): what the dictionaries are made of, at most ``pieces`` rows a language."""
    code = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), code.alias("lang"))
    own = own.where(F.col("key").isNotNull() & ~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    own = own.withColumn("hash", F.xxhash64(F.col("key").cast("string")))
    start = F.pmod(F.col("hash"), F.greatest(F.length("text") - settings.piece_chars + 1, F.lit(1)).cast("long")) + 1
    slot = F.pmod(F.shiftrightunsigned("hash", 8), F.lit(settings.pieces))
    own = own.select("lang", slot.alias("slot"), "hash", F.substring("text", start.cast("int"), F.lit(settings.piece_chars)).alias("piece"))
    least = own.groupBy("lang", "slot").agg(F.min("hash").alias("hash"))
    pieces = own.join(least, ["lang", "slot", "hash"])
    return pieces.groupBy("lang", "slot").agg(F.min("piece").alias("piece"))  # rows that share a key


def dictionaries(pieces: DataFrame, langs_per_block: int) -> Iterator[dict[str, bytes]]:
    """Content by language, so many languages at a time, in the order of their names."""
    rows = groupby(pieces.orderBy("lang", "slot").toLocalIterator(), lambda r: r["lang"])
    by_lang = ((lang, b"\n".join(folded(r["piece"]) for r in own)) for lang, own in rows)
    while block := dict(islice(by_lang, langs_per_block)):
        yield block


#: The best and the second best of the blocks so far: language, size, size.
SO_FAR = "lang string, best long, second long"


def _ranked(batch: pa.RecordBatch, block: dict[str, bytes], digest: str) -> list[tuple[str | None, int | None, int | None]]:
    """The best two of a block and of what a batch carries."""
    coder = worker_state(("language_id", digest), lambda: Coder(block))
    out = []
    for text, lang, best, second in zip(*(batch.column(x).to_pylist() for x in ("text", "lang", "best", "second")), strict=True):
        if coder.langs and text is not None and _LETTER.search(text):
            found = [(size, name) for size, name in ((best, lang), (second, "")) if size is not None]
            # of equal sizes the block before comes first: its languages have smaller names
            order = sorted([*found, *zip(coder.sizes(text), coder.langs, strict=True)], key=lambda x: x[0])
            lang, best, second = order[0][1], order[0][0], order[1][0] if len(order) > 1 else None
        out.append((lang, best, second))
    return out


def _digest(block: dict[str, bytes]) -> str:
    return hashlib.sha256(b"".join(lang.encode() + b"\0" + block[lang] for lang in sorted(block))).hexdigest()


OUT = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def predicted(docs: DataFrame, pieces: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fold, the language, the score, the margin and whether that is too narrow."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"), *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SO_FAR.split(", ")])
    blocks = dictionaries(scratch.table(pieces, "pieces"), settings.langs_per_block)
    block, before = next(blocks, {}), None
    for following in blocks:

        def carry(batch: pa.RecordBatch, block=block, digest=_digest(block)) -> dict[str, pa.Array]:
            lang, best, second = zip(*_ranked(batch, block, digest), strict=True)
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            return cols | {"lang": pa.array(lang, pa.string()), "best": pa.array(best, pa.int64()), "second": pa.array(second, pa.int64())}

        rows = scratch.table(arrow_map(rows, carry, rows.schema), "sizes")
        scratch.drop(before)
        block, before = following, rows

    def each(batch: pa.RecordBatch, block=block, digest=_digest(block)) -> dict[str, pa.Array]:
        langs, best, second = zip(*_ranked(batch, block, digest), strict=True)
        known = np.array([x is not None for x in langs])
        first = np.array([x or 0 for x in best], float)
        other = np.array([x or 0 for x in second], float)
        margin = np.where(known, np.where(other > 0, 1 - first / np.maximum(other, 1), 1.0), 0.0)
        return {
            "doc_id": batch.column(0),
            "held_out": batch.column(1),
            "lang_pred": pa.array([UNKNOWN if x is None else x for x in langs], pa.string()),
            "score": pa.array(1 - np.exp(-settings.sharpness * margin)),
            "margin": pa.array(margin),
            "rejected": pa.array(margin < settings.least_margin),
        }

    return arrow_map(rows, each, OUT)


def identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Dictionaries from the labelled documents outside of the held-out fold, then every document's language."""
    return predicted(docs, training_pieces(docs, settings), settings)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the language of every document of the table."""
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
