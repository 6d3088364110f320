"""Quality rules: distribution divergence from language references.

A document is judged by how far its character classes and its common words lie from
those of a language, measured by the Jensen-Shannon distance (base 2, so 0..1), with a
guard for short texts, beside a few exact counts that act as base rules.

References are additive counts over *all* documents: each Arrow batch contributes the
counts per language (character classes, and words hashed into WORD_BUCKETS buckets), and
Spark sums them by (language, position). A word's common bucket is one of the TOP largest of
a language; all others share one rest bucket. So a reference is CLASSES + 2 * TOP + 1 numbers,
and every language has one. The driver and the executors hold ``langs_per_block`` of them at a
time; where there are more, each further block takes one more pass over the documents, which
carries the nearest reference so far.

Defined results: null or empty text has no words, fails the base rule and is not kept;
repeated rows are judged one by one; null languages, and all rows of a table without a column
of languages, count as language ''; an empty table gives no references and an empty result; texts
of any length are taken whole; other columns may have any names but the two of SO_FAR.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, arrow_map, forget, shared_dir, worker_state, written

SYMBOLS = "#*$%&|<>"
WORD_BUCKETS = 4096
TOP = 48
LANGS_PER_BLOCK = 8192
WINDOW = 8
MIN_WORDS_BASE = 20

#: Character classes by byte: lower, upper, digit, space, sentence marks, other marks, symbols, non-ASCII.
_CLASS = np.full(256, 7, np.int64)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (SPACE, 3), (".,;:?'\"-()", 4), ("!/\\_=+@[]{}~`^", 5), (SYMBOLS, 6)):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
CLASSES = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the method. ``min_words`` is the guard: shorter texts are judged by characters only.

    The noises widen the limits for short texts by noise / sqrt(size), as a histogram of
    few draws lies further from its own source.
    """

    char_limit: float = 0.25
    word_limit: float = 0.48
    min_words: int = 80
    min_chars: int = 100
    char_noise: float = 1.0
    word_noise: float = 0.35


def char_histogram(raw: bytes) -> np.ndarray:
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES)
    return counts.astype(np.int64)


def word_histogram(lower_words: list[bytes]) -> np.ndarray:
    codes = np.fromiter(map(zlib.crc32, lower_words), np.uint32, len(lower_words))
    return np.bincount(codes & (WORD_BUCKETS - 1), minlength=WORD_BUCKETS).astype(np.int64)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of so many words that occurs at least twice, first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = codes * np.uint64(0x9E3779B97F4A7C15) ^ (codes >> np.uint64(7))
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.sort(rolled)
    if not (order[1:] == order[:-1]).any():
        return 0
    again = np.isin(rolled, order[1:][order[1:] == order[:-1]])
    starts = np.flatnonzero(again)
    seen = Counter(tuple(words[i : i + window]) for i in starts)  # exact: equal hashes are only a hint
    cover = np.zeros(len(words) + 1, np.int64)
    for i in starts:
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _entropy(x: np.ndarray) -> np.ndarray:
    """Sum of -x log2 x along the last axis, with 0 for x = 0."""
    return -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=-1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (square root of the base-2 divergence) between rows of counts, 0..1."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-12)
    q = q / np.maximum(q.sum(axis=-1, keepdims=True), 1e-12)
    return np.sqrt(np.clip(_entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2, 0, 1))


@dataclass(frozen=True)
class References:
    """Per language: character class counts, and the common buckets with their counts (rest last)."""

    langs: tuple[str, ...]
    chars: np.ndarray
    tops: np.ndarray
    words: np.ndarray

    def distances(self, chars: np.ndarray, words: np.ndarray) -> tuple[float, float]:
        """Character and word distance to the nearest language (nearest by their sum)."""
        by_char = jensen_shannon(chars, self.chars)
        own = words[self.tops]
        by_word = jensen_shannon(np.concatenate([own, words.sum() - own.sum(axis=1, keepdims=True)], axis=1), self.words)
        best = int(np.argmin(by_char + by_word))
        return float(by_char[best]), float(by_word[best])


def fit_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each language: the histograms of all its documents, summed and cut to the TOP buckets."""
    code = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(code, F.lit("")).alias("lang"))

    def partial(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        worker_state()
        places: dict[str, list[int]] = {}
        for k, code in enumerate(batch.column(1).to_pylist()):
            places.setdefault(code, []).append(k)
        langs, ats, ns = [], [], []
        for code, own in places.items():  # one vector at a time, whatever the number of languages
            total = np.zeros(CLASSES + WORD_BUCKETS, np.int64)
            for k in own:
                raw = batch.column(0)[k].as_py().encode()
                total[:CLASSES] += char_histogram(raw)
                total[CLASSES:] += word_histogram(raw.lower().split())
            at = np.flatnonzero(total)
            langs += [code] * len(at)
            ats.append(at)
            ns.append(total[at])
        if not langs:
            return None
        return {"lang": pa.array(langs, pa.string()), "at": pa.array(np.concatenate(ats), pa.int64()), "n": pa.array(np.concatenate(ns), pa.int64())}

    sums = arrow_map(rows, partial, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    is_char = F.col("at") < CLASSES
    by_size = F.sort_array(F.collect_list(F.when(~is_char, F.struct((-F.col("n")).alias("less"), (F.col("at") - CLASSES).alias("bucket")))))
    by_lang = sums.groupBy("lang").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("at") == k, F.col("n"))), F.lit(0)) for k in range(CLASSES)]).alias("chars"),
        F.slice(by_size, 1, TOP).alias("top"),
        F.coalesce(F.sum(F.when(~is_char, F.col("n"))), F.lit(0)).alias("words"),
    )
    size = F.aggregate("chars", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return by_lang.select("lang", size.alias("size"), "chars", F.col("top.bucket").alias("tops"), F.transform("top.less", lambda x: -x).alias("counts"), "words")


def blocks(found: DataFrame, langs_per_block: int) -> Iterator[References]:
    """All references, the largest languages first, so many at a time."""
    rows = found.orderBy(F.desc("size"), "lang").toLocalIterator()
    while part := list(islice(rows, langs_per_block)):
        tops = np.zeros((len(part), TOP), np.int64)
        words = np.zeros((len(part), TOP + 1), np.int64)
        for k, row in enumerate(part):
            own = row["tops"]
            taken = set(own)
            tops[k] = own + list(islice((x for x in range(2 * TOP) if x not in taken), TOP - len(own)))  # fewer words: empty buckets
            words[k, : len(own)] = row["counts"]
            words[k, TOP] = row["words"] - words[k].sum()
        yield References(tuple(row["lang"] for row in part), np.array([row["chars"] for row in part], np.int64), tops, words)


def nearer(refs: References | None, rules: Rules, raw: bytes, by_char: float | None, by_word: float | None) -> tuple[float | None, float | None]:
    """The distances to the nearest language of refs, or the given ones if no language of refs is nearer."""
    if refs is None or len(raw) < rules.min_chars:
        return by_char, by_word
    found = refs.distances(char_histogram(raw), word_histogram(raw.lower().split()))
    return found if by_char is None or sum(found) < by_char + by_word else (by_char, by_word)


def verdict(rules: Rules, raw: bytes, n_words: int, by_char: float | None, by_word: float | None) -> bool:
    """Whether the distributions are those of a known language, by the distances to the nearest one."""
    if by_char is None:
        return True
    good = by_char <= rules.char_limit + rules.char_noise / np.sqrt(len(raw))
    if n_words >= rules.min_words:
        good = good and by_word <= rules.word_limit + rules.word_noise / np.sqrt(n_words)
    return bool(good)


#: Columns that carry the distances to the nearest reference of the blocks so far.
SO_FAR = ("char_distance_so_far", "word_distance_so_far")


def with_blocks(docs: DataFrame, found: DataFrame, rules: Rules, langs_per_block: int) -> tuple[DataFrame, References | None]:
    """docs with the distances over all blocks of references but the last, and that one."""
    spark = docs.sparkSession
    docs = docs.select("*", *[F.lit(None).cast("double").alias(x) for x in SO_FAR])
    kept = written(found, "references")
    parts = blocks(kept, langs_per_block)
    refs, before = next(parts, None), None
    for following in parts:

        def each(batch: pa.RecordBatch, refs=refs) -> dict[str, pa.Array]:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows = zip(*(cols[x].to_pylist() for x in ("text", *SO_FAR)), strict=True)
            best = [nearer(refs, rules, (body or "").encode(), *so_far) for body, *so_far in rows]
            return cols | {x: pa.array([b[k] for b in best], pa.float64()) for k, x in enumerate(SO_FAR)}

        path = shared_dir(spark, "distances")
        arrow_map(docs, each, docs.schema).write.parquet(path)
        if before:
            forget(spark, before)
        docs, refs, before = spark.read.schema(docs.schema).parquet(path), following, path
    return docs, refs


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, found: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", langs_per_block: int = LANGS_PER_BLOCK) -> DataFrame:
    """One row per document: the base measures, the two distances and whether it is kept."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, refs = with_blocks(rows, found, rules, langs_per_block)

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for body, *so_far in zip(*(x.to_pylist() for x in batch.columns[1:]), strict=True):
            n, chars, symbols, dups, repeats = measures(body)
            failed = n < MIN_WORDS_BASE or 100 * repeats > 30 * n
            raw = body.encode()
            by_char, by_word = nearer(refs, rules, raw, *so_far)
            good = verdict(rules, raw, n, by_char, by_word)
            out.append((n, chars, symbols, dups, repeats, failed, good and not failed, by_char, by_word))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [x.split()[0] for x in OUT.split(", ")[1:]]
        return {"doc_id": batch.column(0)} | {k: pa.array(c, t) for k, c, t in zip(names, cols, kinds, strict=True)}

    return arrow_map(rows, each, OUT)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), langs_per_block: int = LANGS_PER_BLOCK) -> DataFrame:
    """References over all of docs, then the judgement of each of its rows."""
    return judge(docs, fit_references(docs), rules, langs_per_block=langs_per_block)


def keep_good(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), langs_per_block: int = LANGS_PER_BLOCK) -> DataFrame:
    """docs without the rejected rows; every other column and row as it is.

    The judgement is made in the map over the rows themselves, so no join by key is needed
    and rows that share a key are judged one by one.
    """
    fields = docs.schema
    rows, refs = with_blocks(docs, fit_references(docs), rules, langs_per_block)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for body, *so_far in zip(*(batch.column(x).to_pylist() for x in ("text", *SO_FAR)), strict=True):
            raw = (body or "").encode()
            words = raw.split()
            n = len(words)
            failed = n < MIN_WORDS_BASE or 100 * repeat_words(words) > 30 * n
            good.append(not failed and verdict(rules, raw, n, *nearer(refs, rules, raw, *so_far)))
        return batch.select(fields.names).filter(pa.array(good, pa.bool_()))

    def run(batches):
        for batch in batches:
            if batch.num_rows and (kept := each(batch)).num_rows:
                yield kept

    return rows.mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: judge every document of the table."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
