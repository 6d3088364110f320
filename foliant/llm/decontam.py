"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Test items are the indexed documents; every passage of every training document is a query.
Passages are windows of 2 * L words at every L words, L being the longest item, so each run
of L words lies within one. Weights are BM25 over the items, divided by the item's score
against itself, so a score is the share of an item that a passage explains and one
threshold serves all items.

Search is exact in two steps. Terms with the smallest upper bounds, which together cannot
add more than ``slack``, are non-essential. For all passages of a text at once, the bound of
each (passage, item) is summed from the essential postings alone; this is WAND's pivot test.
A passage in which some item's bound can reach the threshold is then walked with block-max
WAND: cursors on postings sorted by item, blocks with their maximal weights, and skips past
blocks that cannot matter. All items at or above the threshold are retrieved, and each is
verified by the overlap of its question and of its answer (word trigrams) with the passage.

The index is sent to the executors for ``items_per_index`` items at a time: that bounds the
broadcast, and a larger benchmark takes more passes, each over all documents. Number of items,
document frequencies, mean length and L are those of all items, so scores do not depend on
the slices; the driver holds the frequencies of the benchmark's vocabulary.

Defined results: null or empty texts have no passages; an item without words matches
nothing; items that repeat are each reported; rows that share a doc_id count as one; an
empty benchmark gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, id_and_text

K1, B = 1.2, 0.75
BLOCK = 32
#: A-Z to a-z, ASCII marks to spaces: what is left between spaces are the words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Config:
    threshold: float = 0.5
    slack: float = 0.05
    overlap: float = 0.5
    items_per_index: int = 50_000


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Word trigrams, or the whole sequence if it is shorter."""
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else ({tuple(words)} if words else set())


class Totals:
    """Number, words, longest item and document frequencies of all items."""

    def __init__(self) -> None:
        self.n, self.words, self.longest = 0, 0, 0
        self.found: Counter[bytes] = Counter()

    def add(self, words: list[bytes]) -> None:
        self.n += 1
        self.words += len(words)
        self.longest = max(self.longest, len(words))
        self.found.update(set(words))


class Index:
    """Postings of a set of items with per-term and per-block maximal weights.

    ``totals`` are those of all items if the set is a slice of them.
    """

    def __init__(self, items: list[tuple[int, str]], config: Config, totals: Totals | None = None) -> None:
        self.config = config
        self.ids = [k for k, _ in items]
        words = [plain_words(t) for _, t in items]
        self.parts = []
        for _, text in items:
            question, _, answer = text.strip().partition("\n")
            self.parts.append((trigrams(plain_words(question)), trigrams(plain_words(answer))))
        if totals is None:
            totals = Totals()
            for ws in words:
                totals.add(ws)
        self.step = max(32, totals.longest)
        n = max(1, totals.n)
        mean = max(1.0, totals.words / n)
        idf = {w: float(np.log(1 + (n - totals.found[w] + 0.5) / (totals.found[w] + 0.5))) for w in {w for ws in words for w in ws}}
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, ws in enumerate(words):
            scores = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in Counter(ws).items()}
            own = sum(scores.values())
            for w, s in scores.items():
                postings.setdefault(w, []).append((k, s / own))
        self.term = {w: k + 1 for k, w in enumerate(sorted(postings, key=lambda w: max(s for _, s in postings[w])))}
        self.lists: list[list[tuple[int, float]]] = [[]] + [postings[w] for w in self.term]
        self.top = [max((s for _, s in x), default=0.0) for x in self.lists]
        self.block_top = [[max(s for _, s in x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.lists]
        self.items_of = [[k for k, _ in x] for x in self.lists]
        # terms are in order of their upper bounds: the first ones are non-essential
        self.essential = int(np.searchsorted(np.cumsum(self.top), config.slack, side="right"))
        used = [x if k >= self.essential else [] for k, x in enumerate(self.lists)]
        self.start = np.cumsum([0, *map(len, used)])
        self.items = np.array([k for x in used for k, _ in x], np.int64)
        self.weights = np.array([s for x in used for _, s in x])

    def hopeful(self, terms: np.ndarray, windows: int) -> np.ndarray:
        """The windows of a text that WAND must walk: where some item's bound reaches the threshold.

        Word k lies in the windows k // step and the one before; in each window a term counts once.
        """
        at = np.flatnonzero(terms >= max(1, self.essential))
        if not len(at):
            return at
        part, width = at // self.step, len(self.lists)
        own = np.unique(np.concatenate([np.minimum(part, windows - 1), np.maximum(part - 1, 0)]) * width + np.tile(terms[at], 2))
        window, own = own // width, own % width
        size = self.start[own + 1] - self.start[own]
        ends = np.cumsum(size)
        offset = np.repeat(self.start[own] - (ends - size), size) + np.arange(ends[-1])
        n = len(self.ids)
        keys, weight = np.repeat(window * n, size) + self.items[offset], self.weights[offset]
        need = self.config.threshold - self.config.slack
        if windows * n <= 8 * len(keys) + 65_536:
            return np.flatnonzero((np.bincount(keys, weight, windows * n).reshape(windows, n) >= need).any(axis=1))
        some, back = np.unique(keys, return_inverse=True)
        return np.unique(some[np.bincount(back, weight) >= need] // n)

    def search(self, terms: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with a score of at least the threshold."""
        limit = self.config.threshold - 1e-9
        cursors = [[self.items_of[t][0], 0, t] for t in terms if t]
        out, end = [], len(self.ids)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the maximal weights of the blocks in which the item would lie
            block, after = 0.0, end
            for cursor in cursors[: pivot + 1]:
                t = cursor[2]
                place = bisect.bisect_left(self.items_of[t], item, cursor[1])
                if place < len(self.items_of[t]):
                    k = place // BLOCK
                    block += self.block_top[t][k]
                    after = min(after, self.items_of[t][min((k + 1) * BLOCK, len(self.items_of[t])) - 1] + 1)
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1][0])
            if block >= limit:
                if cursors[0][0] == item:
                    score = sum(self.lists[t][place][1] for own, place, t in cursors[: pivot + 1] if own == item)
                    if score >= limit:
                        out.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = max(after, item + 1)
            kept = []
            for k, (own, place, t) in enumerate(cursors):
                if k <= pivot and own < goal:
                    place = bisect.bisect_left(self.items_of[t], goal, place)
                    if place == len(self.items_of[t]):
                        continue
                    own = self.items_of[t][place]
                kept.append([own, place, t])
            cursors = kept
        return out

    def leaks(self, text: str) -> dict[int, tuple[float, float, float]]:
        """item number -> (score, question overlap, answer overlap) of the items that a text holds."""
        words = plain_words(text)
        if not words:
            return {}
        terms = np.fromiter(map(self.term.get, words, repeat(0)), np.int64, len(words))
        windows = max(1, -(-len(words) // self.step) - 1)
        found: dict[int, tuple[float, float, float]] = {}
        for k in self.hopeful(terms, windows):
            start, stop = int(k) * self.step, (int(k) + 2) * self.step
            grams = None
            for item, score in self.search(set(terms[start:stop].tolist())):
                if grams is None:
                    grams = trigrams(words[start:stop]) | {tuple(words[i : i + n]) for n in (1, 2) for i in range(start, min(stop, len(words)) - n + 1)}
                question, answer = (len(g & grams) / len(g) if g else 1.0 for g in self.parts[item])
                if question >= self.config.overlap and answer >= self.config.overlap and (item not in found or score > found[item][0]):
                    found[item] = (score, question, answer)
        return found


def _indexes(items: DataFrame, config: Config) -> Iterator[Index]:
    """An index for each slice of the items; a slice is what the driver holds at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    totals = Totals()
    for r in rows.toLocalIterator():
        if words := plain_words(r["text"]):
            totals.add(words)
    part: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        if plain_words(r["text"]):
            part.append((r["item_id"], r["text"]))
        if len(part) == config.items_per_index:
            yield Index(part, config, totals)
            part = []
    if part:
        yield Index(part, config, totals)


OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each (document, item) such that the document holds the item."""
    spark, rows = docs.sparkSession, id_and_text(docs)
    out = None
    for index in _indexes(items, config):
        sent = spark.sparkContext.broadcast(index)

        def each(batch: pa.RecordBatch, sent=sent) -> dict[str, pa.Array] | None:
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found += [(doc, sent.value.ids[k], *x) for k, x in sent.value.leaks(text).items()]
            if not found:
                return None
            cols = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 2 + [pa.float64()] * 3
            return {x.split()[0]: pa.array(c, t) for x, c, t in zip(OUT.split(", "), cols, kinds, strict=True)}

        part = arrow_map(rows, each, OUT)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], OUT)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean_rows(spark: SparkSession, docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """docs without the rows that hold a test item; every other row and column as it is."""
    names = docs.columns
    for index in _indexes(items, config):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for batch in batches:
                texts = batch.column(names.index("text")).to_pylist()
                good = batch.filter(pa.array([not sent.value.leaks(t or "") for t in texts], pa.bool_()))
                if good.num_rows:
                    yield good

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document that holds an item of the benchmark, with its scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
