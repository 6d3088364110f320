"""Substring dedup with a compressed FM-index per shard.

A window of ``window`` words is assigned to a shard by its content: by its minimizer, the
smallest hash among its word ``gram``-grams. Equal windows of any two documents so meet in
one shard, and neighbouring windows with one minimizer travel as one segment.

1. Every document gives its segments as (minimizer, digest, document, place). Minimizers of
   a single document are dropped: their windows are unique in the corpus.
2. Segments with equal digests are one; the smallest document id owns it. Only owners give
   words, so exact copies cost nothing.
3. Where a minimizer has more than ``hot`` different segments (a passage amid ever different
   text), the windows of these are first counted one by one and the segments trimmed to
   windows that two documents at least have, which again collapses them. What is left of them
   is dealt to shards by a second minimizer, of another hash, besides the first, so that the
   neighbourhoods of a common phrase go to different shards.
4. A shard's distinct segments are indexed: BWT in a wavelet matrix, common prefixes of
   neighbouring rows and the smallest document id of every class of ``window`` words. The
   segments are then streamed against the index: backward search extends their interval word
   by word and gives the matching statistics; a match of ``window`` words reports the smallest
   document id in its interval. Shards hold whole minimizers, some ``shard_words`` words at a
   time.
5. Windows that a smaller id has are joined back to the documents and their words removed.

Defined results: null or empty text has no words; a text with fewer words than a window
keeps them all; rows that share a doc_id are judged one by one, each against the rows of
smaller ids; rows with a null id stay whole and own nothing; repeated rows get equal results;
an empty table gives an empty result; texts of any length are taken whole; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, arrow_map, id_and_text
from foliant.llm.fm_index import FMIndex

_POWERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)]


@dataclass(frozen=True)
class Config:
    window: int = 50
    gram: int = 8
    hot: int = 16  # different segments of a minimizer from which they are trimmed first
    longest: int = 256  # windows in a segment
    shard_words: int = 250_000


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def minimizers(codes: np.ndarray, config: Config, seed: int = 0) -> np.ndarray:
    """The smallest gram hash of every window; every seed gives another order of the grams."""
    n = len(codes) - config.gram + 1
    codes = codes ^ np.uint64(seed)
    grams = np.zeros(n, np.uint64)
    for k in range(config.gram):
        grams += codes[k : k + n] * np.uint64(_POWERS[k])
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    width = config.window - config.gram + 1
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = grams
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(values: np.ndarray, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of equal values, cut to at most so many."""
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for at in range(a, b, longest):
            yield at, min(longest, b - at)


def _digest(codes: np.ndarray, start: int, windows: int, config: Config) -> bytes:
    return xxhash.xxh3_128_digest(codes[start : start + windows + config.window - 1].tobytes())


SEGMENT = "v long, sig binary, doc_id long, text_key long, start int, windows int"


def _columns(schema: str, rows: list[tuple]) -> dict[str, pa.Array] | None:
    if not rows:
        return None
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return {name: pa.array(col, kinds[kind]) for (name, kind), col in zip(fields, zip(*rows, strict=True), strict=True)}


def segments(docs: DataFrame, config: Config) -> DataFrame:
    """All segments of (doc_id, text, text_key), without their words."""

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        rows = []
        for doc, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().split()
            if len(words) >= config.window:
                codes = word_codes(words)
                v = minimizers(codes, config).view(np.int64)
                rows += [(int(v[a]), _digest(codes, a, n, config), doc, key, a, n) for a, n in runs(v, config.longest)]
        return _columns(SEGMENT, rows)

    return arrow_map(docs.where("doc_id IS NOT NULL"), each, SEGMENT)


OWNED = "v long, sig binary, owner long, last long, body binary"


def _owned_words(docs: DataFrame, owners: DataFrame, scratch: Scratch, config: Config) -> DataFrame:
    """(v, sig, owner, last, body): the words of every distinct segment, from its owner's text."""
    wanted = owners.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("v", "sig", "start", "windows", "last")).alias("own"))
    wanted = scratch.table(wanted, "segment-owners")

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        rows = []
        for doc, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().split()
            rows += [(x["v"], x["sig"], doc, x["last"], b" ".join(words[x["start"] : x["start"] + x["windows"] + config.window - 1])) for x in own]
        return _columns(OWNED, rows)

    joined = docs.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    owned = scratch.table(arrow_map(joined.select("doc_id", "text", "own"), each, OWNED), "owned")
    scratch.drop(wanted)
    return owned


PIECE = "v long, sig binary, offset int, k long, piece binary, owner long, body binary"
_SECOND = 0xD6E8FEB86659FD93


def _trimmed(owned: DataFrame, scratch: Scratch, config: Config) -> DataFrame:
    """Distinct segments of hot minimizers as pieces: stretches of windows that two documents at least have, by second minimizers k."""
    schema = "w binary, v long, sig binary, at int, owner long, last long"

    def windows(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        rows = []
        for v, sig, owner, last, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = word_codes(body.split())
            rows += [(_digest(codes, k, 1, config), v, sig, k, owner, last) for k in range(len(codes) - config.window + 1)]
        return _columns(schema, rows)

    each = scratch.table(arrow_map(owned, windows, schema), "hot-windows")
    # a table of its own, so that AQE can split a window that very many segments have
    often = scratch.table(each.groupBy("w").agg(F.min("owner").alias("a"), F.max("last").alias("b")).where("a <> b").select("w"), "hot-repeated")
    places = scratch.table(each.join(often, "w", "left_semi").groupBy("v", "sig").agg(F.collect_list("at").alias("places")), "hot-places")
    scratch.drop(each, often)

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        rows = []
        for v, sig, owner, body, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words, at = body.split(), np.sort(np.array(found, np.int64))
            codes = word_codes(words)
            second = minimizers(codes, config, _SECOND) ^ np.uint64(v & 0xFFFFFFFFFFFFFFFF)
            for part in np.split(at, np.flatnonzero((np.diff(at) != 1) | (second[at[1:]] != second[at[:-1]])) + 1):
                a, n = int(part[0]), len(part)
                rows.append((v, sig, a, int(second[a].view(np.int64)), _digest(codes, a, n, config), owner, b" ".join(words[a : a + n + config.window - 1])))
        return _columns(PIECE, rows)

    pieces = scratch.table(arrow_map(owned.join(places, ["v", "sig"]).select("v", "sig", "owner", "body", "places"), cut, PIECE), "pieces")
    scratch.drop(places)
    return pieces


FOUND = "v long, sig binary, offset int, length int, smallest long"


def _searched(words: DataFrame, config: Config) -> DataFrame:
    """(v, sig, owner, body) to stretches of windows (offset, length) of each segment and the smallest document that has them."""

    def flush(part: list[tuple]) -> pa.RecordBatch:
        streamed = [word_codes(body.split()) for _, _, _, body in part]
        index = FMIndex(streamed, [o for _, _, o, _ in part], config.window)
        rows = []
        for (v, sig, _, _), (_, smallest) in zip(part, index.matching_statistics(streamed), strict=True):
            smallest = smallest[: len(smallest) - config.window + 1]  # later places have fewer words
            edges = np.concatenate([[0], np.flatnonzero(smallest[1:] != smallest[:-1]) + 1, [len(smallest)]]).tolist()
            rows += [(v, sig, a, b - a, int(smallest[a])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_pydict(_columns(FOUND, rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= config.shard_words:
                    yield flush(part)
                    part, size = [], 0
                part.append(row)
                size += row[3].count(b" ") + 1
                last = row[0]
        if part:
            yield flush(part)

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = words.select("v", "sig", "owner", "body").repartition(n, "v").sortWithinPartitions("v", "owner", "sig")
    return sharded.mapInArrow(run, FOUND)


def repeated_spans(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text_key, start, windows): stretches of windows that a smaller document also has; docs is (doc_id, text, text_key)."""
    scratch = Scratch(docs.sparkSession)
    all_segments = scratch.table(segments(docs, config), "segments")
    often = all_segments.groupBy("v").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("v")
    some = scratch.table(all_segments.join(often, "v", "left_semi"), "repeated-segments")
    scratch.drop(all_segments)
    first = F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("o")
    owners = scratch.table(some.groupBy("v", "sig").agg(first, F.max("doc_id").alias("last")).select("v", "sig", "o.*", "last"), "owners")
    hot = scratch.table(owners.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > config.hot).select("v"), "hot")
    owned = _owned_words(docs, owners, scratch, config)
    scratch.drop(owners)
    found = scratch.table(_searched(owned.join(hot, "v", "left_anti"), config), "found")
    pieces = _trimmed(owned.join(hot, "v", "left_semi"), scratch, config)
    scratch.drop(owned)
    once = pieces.groupBy("k", "piece").agg(F.min(F.struct("owner", "body")).alias("o")).select(F.col("k").alias("v"), F.col("piece").alias("sig"), "o.owner", "o.body")
    inner = scratch.table(_searched(once, config), "found-pieces").withColumnsRenamed({"v": "k", "sig": "piece", "offset": "inner"})
    cut = pieces.select("v", "sig", "offset", "k", "piece").join(inner, ["k", "piece"]).select("v", "sig", (F.col("offset") + F.col("inner")).alias("offset"), "length", "smallest")
    hits = some.join(found.unionByName(cut), ["v", "sig"]).where("smallest < doc_id")
    spans = scratch.table(hits.select("doc_id", "text_key", (F.col("start") + F.col("offset")).alias("start"), F.col("length").alias("windows")), "spans")
    scratch.drop_all_but(spans)
    return spans


def deduplicated(docs: DataFrame, config: Config = Config(), with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text) of every row; text is the kept words joined by spaces."""
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(rows, config).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, removed, digest, texts = [], [], [], []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            n.append(len(words))
            if own:
                change = np.zeros(len(words) + 1, np.int64)
                for x in own:
                    change[x["start"]] += 1
                    change[x["start"] + x["windows"] + config.window - 1] -= 1
                keep = np.cumsum(change[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            removed.append(n[-1] - len(words))
            kept = b" ".join(words)
            digest.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        return {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "text": pa.array(texts, pa.string())}

    return arrow_map(rows.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans"), each, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: words before, words removed and a digest of the kept ones, per document."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("text")
