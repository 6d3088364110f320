"""N-gram Jaccard join with a token-group matrix; exact at the threshold.

A document's set holds the 64-bit hashes of its distinct shingles of five words. Documents
with equal sets (equal 128-bit digests of the sorted hashes) are one class; from there on
only the smallest id of each class, its representative, takes part.

Order. All tokens are ordered by how frequent they are, then by hash. Frequencies come from
a sketch of counts over all documents. It has a bucket for every few tokens of the corpus, up
to 2^``most_bits`` buckets, and is reduced to one byte each for the order, so at most 8 MB go
to an executor. Beyond that size buckets hold more tokens and tell only more frequent ones
from rare ones; any order gives the same links. Two sets of Jaccard similarity of at least
0.8 share a token among the first n - ceil(0.8 n) + 1 of either, so only these prefixes are
joined, and passages that a large part of the corpus shares hardly ever lie in one.

Groups. Tokens that only one representative has are dropped, and tokens that the same
representatives have become one with a weight. Then, in rounds, every group (first a single
document) is compared with one document of another group, the one it shares most prefix tokens
with among the leading documents of its tokens. Leading are first those that share the largest
part of their own tokens, which stand in the middle of their like, then others. Verified pairs
merge, so similar documents come to share a group, and a token whose documents all lie in one
group needs no more work. This replaces the pairs within a cluster by a star.

Matrix. What is left are the tokens of several groups. The token-group matrix has each group's
open prefix tokens, members of one band of sizes apart, with the smallest and largest size that
have the token; their union is stored as a bit set of fixed size. A query asks a group if one token stands far enough in front
in both; then the weights of all tokens that it shares with the group's union are summed. If x and y are similar, with n and m tokens, then the
tokens that their prefixes share are at least ceil(0.8 (n + m) / 1.8) - ceil(0.8 max(n, m)) + 1,
for all others lie behind the prefix that ends first. So a sum below the least such number over
the group's sizes rules the whole group out. Only groups that qualify are opened, and their
members that share such a token compared exactly. So no link between different texts is lost,
and none is expanded into all pairs of a cluster. Of two groups the best pair is compared first; if it links
them, their other pairs are not needed.

Candidate texts are written once, hashed into buckets by document, and joined in place; a text
moves only once for each pair that is verified. Tables are dropped when nothing reads them.

Defined results: a null or empty text, or one without words, has an empty set, links with
nothing and is its own component; rows that share a doc_id are one document, which links if any
of its texts does (a row of it without words still gets its own id as component); a null doc_id
has no component; an empty table gives an empty result; texts of any length are taken whole; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, arrow_map, id_and_text, tidy, worker_state, written
from foliant.llm.components import connected

SLICES, ADDERS = 16, 8
UNION_WORDS = 32
_POWERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)]


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 80
    rounds: int = 2
    parts: int = 16  # a part of the pairs of groups is compared first
    most_bits: int = 23  # of the token order's buckets
    band: float = 1.1  # ratio of the sizes in a band of a group


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of A-Z-lowered words."""
    own = text.encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), len(own))], np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = len(own) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out += codes[k : k + n] * np.uint64(_POWERS[k])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with a similar one."""
    return -(-n * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def token_levels(docs: DataFrame, config: Config) -> np.ndarray:
    """One byte for each bucket of tokens: eight times the log2 of its count over the mean."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(config.most_bits, max(16, (chars // 32).bit_length()))  # a bucket for some five tokens

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for text in batch.column(1):
                at = (shingles(text.as_py(), config.words) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(total, at, np.int32(1))
        if total.any():
            yield _slices(total.reshape(SLICES, -1), range(SLICES))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield _slices(sums.values(), sums)

    schema = "slice int, counts binary"
    # many tasks' counts are added in two steps, the first of them by SLICES * ADDERS tasks
    parts = docs.mapInArrow(count, schema).withColumn("adder", F.spark_partition_id() % ADDERS)
    parts = parts.repartition(SLICES * ADDERS, "slice", "adder").select("slice", "counts").mapInArrow(add, schema)
    total = np.zeros((SLICES, (1 << bits) // SLICES), np.int64)
    with tidy(docs.sparkSession):
        sums = parts.repartition(SLICES, "slice").mapInArrow(add, schema).collect()  # SLICES rows of fixed size
    for r in sums:
        total[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    mean = max(1.0, float(total.mean()))
    return np.concatenate([np.clip(np.floor(8 * np.log2(np.maximum(x / mean, 1))), 0, 255).astype(np.uint8) for x in total])


def _slices(counts: Iterable[np.ndarray], names: Iterable[int]) -> pa.RecordBatch:
    """A row for each slice of the counts, compressed."""
    return pa.RecordBatch.from_pydict({"slice": pa.array(list(names), pa.int32()), "counts": pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1) for x in counts], pa.binary())})


def signatures(docs: DataFrame, levels: np.ndarray, config: Config) -> DataFrame:
    """(doc_id, n, sig, prefix) of every row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    bits = len(levels).bit_length() - 1

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        level = sent.value
        n, sigs, prefixes = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py(), config.words)
            n.append(len(found))
            sigs.append(xxhash.xxh3_128_digest(found.tobytes()))
            size = len(found) - need(len(found), config.percent) + 1 if len(found) else 0
            order = np.argsort(level[(found >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:size]
            prefixes.append(found[order].view(np.int64))
        return {"doc_id": batch.column(0), "n": pa.array(n, pa.int32()), "sig": pa.array(sigs, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))}

    return arrow_map(docs, each, "doc_id long, n int, sig binary, prefix array<long>")


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, config: Config) -> DataFrame:
    """The pairs (x, y) whose documents are similar; texts is (doc_id, text) in buckets of doc_id.

    Texts of x are met in their buckets. The texts of the y that occur are written, so that the
    second join deals both sides anew and AQE can split a y that very many x are compared with.
    Rows arrive in order of y, so a set is made once for a run of equal y.
    """
    asked = scratch.table(texts.join(pairs.select(F.col("y").alias("doc_id")).distinct(), "doc_id", "left_semi"), "asked-texts")
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "x", "text": "text_x"}).hint("merge"), "x")
    both = left.join(asked.withColumnsRenamed({"doc_id": "y", "text": "text_y"}).hint("merge"), "y").select("x", "y", "text_x", "text_y")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_y, kept_text, set_y = None, None, None
        for batch in batches:
            xs, ys, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k in range(batch.num_rows):
                text = batch.column(3)[k].as_py()
                if ys[k] != kept_y or text != kept_text:  # rows that share a doc_id have several texts
                    kept_y, kept_text, set_y = ys[k], text, shingles(text, config.words)
                good.append(similar(shingles(batch.column(2)[k].as_py(), config.words), set_y, config.percent))
            found = [k for k, g in enumerate(good) if g]
            if found:
                yield pa.RecordBatch.from_pydict({"x": pa.array([xs[k] for k in found], pa.int64()), "y": pa.array([ys[k] for k in found], pa.int64())})

    found = scratch.table(both.mapInArrow(each, "x long, y long").distinct(), "verified")
    scratch.drop(asked)
    return found


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    """Two sets of these sizes can be similar."""
    return (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))


def _reaches(size: str, at: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether a set's tokens from a position on can make up the overlap that sizes n and m need.

    Of two similar sets the first shared token stands so far in front in both.
    """
    return (F.col(size) - at) * (100 + percent) >= percent * (n + m)


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """A lower bound of the prefix tokens that similar sets of n and m tokens share."""
    both = F.ceil(percent * (n + m) / F.lit(100 + percent) - F.lit(1e-6))
    return both - F.ceil(percent * F.greatest(n, m) / F.lit(100) - F.lit(1e-6)) + 1


def links_and_components(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows = id_and_text(docs)
    scratch = Scratch(docs.sparkSession)
    own = scratch.table(signatures(rows, token_levels(rows, config), config), "signatures")
    sizes = scratch.table(own.select("doc_id", "n", "sig"), "sizes")
    known = sizes.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(known.groupBy("sig").agg(F.min("doc_id").alias("rep")), "classes")
    # a document of several texts joins the classes of all of them
    several = known.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a <> b").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").join(classes, "sig").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    ties = scratch.table(ties, "ties")
    edges = _links(rows, own, classes, scratch, config)
    edges = ties if edges is None else edges.unionByName(ties)
    merged = connected(edges, scratch)
    by_class = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("root", "rep").alias("component_id"))
    by_class = scratch.table(by_class, "class-components")
    scratch.drop_all_but(sizes, by_class)
    out = sizes.join(by_class, "sig", "left")
    alone = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def _links(rows: DataFrame, own: DataFrame, classes: DataFrame, scratch: Scratch, config: Config) -> DataFrame | None:
    """Edges (a, b) that connect representatives as their links do; None if there is no candidate. ``own`` is dropped."""
    reps = classes.select(F.col("rep").alias("doc_id"), "sig")
    prefixes = own.join(reps, ["doc_id", "sig"], "left_semi")
    tokens = prefixes.select(F.col("doc_id").alias("x"), "n", F.posexplode("prefix").alias("at", "t"))
    # Tokens of the same documents say the same about pairs, so they become one token, named by
    # their documents, with the smallest position; names that collide only add candidates.
    who = F.sum(F.xxhash64("x").bitwiseAND(F.lit(0x7FFFFFFF)))
    shared = tokens.groupBy("t").agg(F.min("x").alias("a"), F.max("x").alias("b"), who.alias("s"), F.count("*").alias("c")).where("a <> b")
    shared = scratch.table(shared.select("t", F.xxhash64("a", "b", "s", "c").alias("name")), "shared-tokens")
    named = tokens.join(shared, "t").groupBy("name", "x", "n").agg(F.min("at").alias("at"), F.count("*").alias("weight"))
    named = scratch.table(named.withColumnRenamed("name", "t"), "named-tokens")
    # a document in the middle of its like shares most of its prefix, so it is a good one to compare with
    middle = named.groupBy("x", "n").agg((F.sum("weight") / F.col("n")).alias("share"))
    tokens = scratch.table(named.join(middle, ["x", "n"]), "tokens")
    scratch.drop(named)
    scratch.drop(own, shared)
    if not tokens.limit(1).count():
        return None
    texts = scratch.bucketed(rows.join(tokens.select(F.col("x").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidate-texts", "doc_id")
    comps = None  # (node, root) of what has merged so far

    def labelled() -> DataFrame:
        if comps is None:
            return tokens.withColumn("comp", F.col("x"))
        return scratch.table(tokens.join(comps.select(F.col("node").alias("x"), "root"), "x", "left").select("t", "x", "n", "at", "weight", "share", F.coalesce("root", "x").alias("comp")), "labelled")

    def open_tokens(now: DataFrame, k: int) -> DataFrame:
        """The tokens that several groups have, with a leading document of each: the one that shares most, then in every round another one."""
        first = F.xxhash64("x", F.lit(k)) if k else F.col("share")
        lead = now.groupBy("t").agg(F.max(F.struct(first.alias("first"), "comp", "x", "n", "at")).alias("lead"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
        return scratch.table(lead.select("t", F.col("lead.comp").alias("to"), F.col("lead.x").alias("y"), F.col("lead.n").alias("m"), F.col("lead.at").alias("to_at")), "leads")

    for k in range(config.rounds):
        now = labelled()
        lead = open_tokens(now, k)
        n, m = F.col("n"), F.col("m")
        fits = _sizes_fit("n", "m", config.percent) & _reaches("n", F.col("at"), n, m, config.percent) & _reaches("m", F.col("to_at"), n, m, config.percent)
        votes = now.join(lead, "t").where("comp <> to").where(fits).groupBy("comp", "to", "x", "y").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("comp").agg(F.max(F.struct("votes", "to", "x", "y")).alias("best"))
        pairs = scratch.table(best.select("comp", "best.to", "best.x", "best.y"), "pairs")
        found = verified(pairs.select("x", "y"), texts, scratch, config)
        roots = connected(pairs.join(found, ["x", "y"], "left_semi").select(F.col("comp").alias("a"), F.col("to").alias("b")), scratch).where("node <> root")
        left = scratch.table(now.join(lead.select("t"), "t", "left_semi").select("t", "x", "n", "at", "weight", "share"), "tokens")
        scratch.drop(tokens, now, lead, pairs, found)
        tokens = left
        if not roots.limit(1).count():
            break
        if comps is None:
            comps = scratch.table(roots, "components")
        else:
            old = comps.withColumnRenamed("root", "comp").join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("root"))
            fresh = roots.join(comps, "node", "left_anti")
            both = scratch.table(old.unionByName(fresh), "components")
            scratch.drop(comps)
            comps = both

    now = labelled()
    pairs = _opened(now, scratch, config)
    # The best pair of two groups and a part of the others first: where these link them, no other pair of theirs is needed.
    best = pairs.groupBy("comp", "to").agg(F.max(F.struct("votes", "x", "y")).alias("best")).select("best.x", "best.y")
    part = F.pmod(F.xxhash64("x", "y"), F.lit(config.parts)) == 0
    early = scratch.table(pairs.select("x", "y").where(part).unionByName(best).distinct(), "early-pairs")
    first = verified(early, texts, scratch, config)
    roots = connected(pairs.join(first, ["x", "y"], "left_semi").select(F.col("comp").alias("a"), F.col("to").alias("b")), scratch)
    rest = pairs.join(early, ["x", "y"], "left_anti")
    for side in ("comp", "to"):
        rest = rest.join(roots.withColumnsRenamed({"node": side, "root": f"{side}_root"}), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    rest = scratch.table(rest.where("comp_root <> to_root").select("x", "y"), "other-pairs")
    found = first.unionByName(verified(rest, texts, scratch, config))
    scratch.drop(tokens, now, pairs, early, rest, texts)
    edges = found.select(F.col("x").alias("a"), F.col("y").alias("b"))
    return edges if comps is None else edges.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b")))


def _opened(now: DataFrame, scratch: Scratch, config: Config) -> DataFrame:
    """Pairs (x, y) of different groups (comp, to) that the token-group matrix cannot rule out, with the weight that lets them.

    Of two groups the one with the larger label asks. The first shared token of a similar pair
    stands far enough in front, so only groups with such a token are asked; one is opened if the
    weights of all tokens that the query shares with its union reach the least overlap of
    prefixes for any of its sizes. Of an opened group the members with such a token are compared.
    """
    n, m, p = F.col("n"), F.col("m"), config.percent
    several = now.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("t")
    banded = now.join(several, "t", "left_semi").withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(config.band))).cast("int"))
    rest = scratch.table(banded, "matrix-tokens")
    matrix = rest.groupBy("t", "comp", "band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("at").alias("first"))
    matrix = scratch.table(matrix.withColumnsRenamed({"comp": "to", "band": "to_band"}), "matrix")
    low, high = F.col("low"), F.col("high")
    # every member has a size of low at least, so the overlap that it needs is bounded from below
    ahead = (100 * high >= p * n) & (p * low <= 100 * n) & _reaches("n", F.col("at"), n, low, p) & _reaches("high", F.col("first"), n, low, p)
    hits = rest.join(matrix, "t").where(F.col("comp") > F.col("to")).where(ahead)
    hits = scratch.table(hits.select("t", "comp", "x", "n", "at", "weight", "to", "to_band", "low", "high"), "asked-groups")
    asked = hits.groupBy("x", "n", "to", "to_band").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # a group's union in UNION_WORDS words of 64 bits; tokens that share a bit only raise a sum
    bit = F.expr("shiftleft(1L, cast(pmod(t, 64) AS int))")
    place = F.pmod(F.shiftright("t", 6), F.lit(UNION_WORDS))
    union = rest.groupBy(F.col("comp").alias("to"), F.col("band").alias("to_band")).agg(F.array(*[F.coalesce(F.bit_or(F.when(place == k, bit)), F.lit(0).cast("long")) for k in range(UNION_WORDS)]).alias("union"))
    own = rest.groupBy("x", "n").agg(F.collect_list(F.struct(place.cast("int").alias("place"), F.pmod("t", F.lit(64)).cast("int").alias("bit"), "weight")).alias("tokens"))
    in_union = F.aggregate("tokens", F.lit(0).cast("long"), lambda sum_, t: sum_ + t["weight"] * F.call_function("bit_get", F.element_at("union", t["place"] + 1), t["bit"]))
    # the bound is concave in the size, so its least value is at an end; one less for its rounding
    low, high = F.greatest(F.col("low"), F.floor(p * n / F.lit(100))), F.least(F.col("high"), F.ceil(100 * n / F.lit(p)))
    bound = F.least(_least_shared(n, low, p), _least_shared(n, high, p)) - 1
    opened = asked.join(union, ["to", "to_band"]).join(own, ["x", "n"]).where(in_union >= bound)
    opened = scratch.table(opened.select("x", "n", "to", "to_band"), "opened-groups")
    inside = rest.select("t", F.col("comp").alias("to"), F.col("band").alias("to_band"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("at").alias("to_at"))
    ahead = _sizes_fit("n", "m", p) & _reaches("n", F.col("at"), n, m, p) & _reaches("m", F.col("to_at"), n, m, p)
    members = hits.join(opened, ["x", "n", "to", "to_band"]).join(inside, ["t", "to", "to_band"]).where(ahead)
    pairs = scratch.table(members.groupBy("comp", "to", "x", "y").agg(F.sum("weight").alias("votes")), "opened-pairs")
    scratch.drop(rest, matrix, hits, opened)
    return pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: set size and component of every document."""
    return links_and_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs with only the smallest id of each component; rows without an id stay."""
    found = links_and_components(docs, config)
    lost = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
