"""URL filters by a Bloom filter cascade, with DataFrame functions only.

Rules are (host, path, verdict). A rule fits a url if the url's host is the rule's host or
a subdomain of it and the url's path starts with the rule's path; the longest rule wins
(host and path together, then the longer host).

A url's keys are host suffix + "/"-less path prefix pairs whose label counts and path
lengths occur among the rules, so that few keys are made and none that could fit is missed.
For each verdict a cascade answers exactly whether a key is listed:

* level 1 is a Bloom filter of the listed keys;
* level 2 is one of level 1's false positives over every key of the corpus;
* level 3 is one of the listed keys that level 2 wrongly holds, and so on, until a level
  has no false positives. A key is listed if the first level that lacks it is an even one
  (or if it passes all and their number is odd).

Level 1 has about log2(keys of the corpus / listed keys) hash functions, so its false
positives are about as many as the listed keys and the whole cascade needs some
1.5 * log2(corpus / listed) + 6 bits per *listed* key: it grows with the rule list and only
with the logarithm of the corpus. ``max_bits`` bounds what is sent to the executors as
literals; a longer rule list is refused with an error instead of a silent change of method.
The corpus's keys are never collected: one pass counts them, one finds level 1's false
positives, and what is counted or collected afterwards is a small multiple of the rules.
Judging urls uses no join.

Defined results: a null url or one without "://" has an empty host and path, fits no rule
and is allowed; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS = 63  # bits used of each long


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words of BITS bits, its size in bits and its number of hashes."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int


def host_of(url: Column) -> Column:
    """Between the first "://" and "/", "?", "#" or the end, A-Z lowered; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def keys_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Array of the keys that a rule could have, for label counts and path lengths of the rules."""
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    parts = F.split(host, r"\.", -1)
    made = [
        F.when((F.size(parts) >= n) & (F.length(path) >= m), key_of(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n in labels
        for m in lengths
    ]
    return F.array_compact(F.array(*made))


def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Bit places of a key: double hashing of two 31-bit halves, which cannot overflow."""
    mask = F.lit(0x7FFFFFFF)
    a = F.xxhash64(key, F.lit(2 * seed)).bitwiseAND(mask)
    b = F.xxhash64(key, F.lit(2 * seed + 1)).bitwiseAND(mask)
    return [F.pmod(a + F.lit(k) * b, F.lit(bits)) for k in range(hashes)]


def holds(level: Level, key: Column) -> Column:
    """Whether the filter holds a key; its words are one literal, folded once when the plan is made."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<long>")
    at = F.array(*places(key, level.bits, level.hashes, level.seed))
    return F.forall(at, lambda x: F.call_function("bit_get", F.element_at(words, (x / BITS).cast("int") + 1), (x % BITS).cast("int")) == 1)


def build_level(keys: DataFrame, n: int, hashes: int, seed: int) -> Level:
    """A filter of the distinct keys in column ``key``, of which there are n."""
    bits = max(BITS, math.ceil(n * hashes / math.log(2)))
    at = keys.select(F.explode(F.array(*places(F.col("key"), bits, hashes, seed))).alias("at"))
    words = at.select((F.col("at") / BITS).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % BITS).cast("int")).alias("bit"))
    found = {r["word"]: r["bits"] for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()}  # bits / 63 rows
    return Level(tuple(found.get(k, 0) for k in range(math.ceil(bits / BITS))), bits, hashes, seed)


def listed(levels: list[Level], key: Column) -> Column:
    """Whether the cascade says that a key is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(~holds(levels[k], key), F.lit(k % 2 == 1)).otherwise(out)
    return out


def build_cascade(universe: DataFrame, n_universe: int, keys: DataFrame, n_keys: int, seed: int, max_bits: int) -> list[Level]:
    """Levels for the listed keys over a universe of keys (column ``key``, repeats allowed)."""
    if not n_keys:
        return []
    first = max(1, math.ceil(math.log2(max(2, n_universe / n_keys))))
    if n_keys * (1.5 * first + 6) > max_bits:
        raise ValueError(f"the filter of {n_keys} rules would need more than max_bits={max_bits} bits")
    levels = [build_level(keys, n_keys, first, seed)]
    wrong = universe.where(holds(levels[0], F.col("key"))).select("key").distinct().join(F.broadcast(keys) if n_keys < 100_000 else keys, "key", "left_anti").cache()
    others, n_wrong, held = keys, wrong.count(), [wrong]
    while n_wrong:
        seed += 1
        level = build_level(wrong, n_wrong, 2, seed)
        levels.append(level)
        right = others.where(holds(level, F.col("key"))).cache()
        held.append(right)
        others, wrong, n_wrong = wrong, right, right.count()
    for x in held:  # small multiples of the rules; the levels are all that is used from here on
        x.unpersist()
    return levels


def cascades(urls: DataFrame, rules: tuple[tuple[str, str, str], ...], max_bits: int) -> dict[str, list[Level]]:
    """A cascade for each verdict, over all keys of urls (columns host, path)."""
    spark = urls.sparkSession
    universe = urls.select(F.explode(keys_of(F.col("host"), F.col("path"), rules)).alias("key"))
    size = urls.agg(F.coalesce(F.sum(F.size(keys_of(F.col("host"), F.col("path"), rules))), F.lit(0))).first()[0]
    out = {}
    for k, verdict in enumerate(sorted({v for _, _, v in rules})):
        own = [(f"{h}\n{p}",) for h, p in sorted({(h, p) for h, p, v in rules if v == verdict})]
        keys = spark.createDataFrame(own, "key string").coalesce(1)
        out[verdict] = build_cascade(universe, size, keys, len(own), 1000 * (k + 1), max_bits)
    return out


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow", max_bits: int = 1 << 24) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_verdict = cascades(urls.select("host", "path"), rules, max_bits)

    def mark(key: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, levels in by_verdict.items():
            verdict = F.when(listed(levels, key), F.lit(name)).otherwise(verdict)
        host = F.substring_index(key, "\n", 1)
        # the first in order of length, then of the host's length; "\n" stands between host and path
        return F.struct(F.length(key).alias("size"), F.length(host).alias("host_size"), F.regexp_replace(key, "\n", "").alias("rule"), verdict.alias("verdict"))

    fits = F.filter(F.transform(keys_of(F.col("host"), F.col("path"), rules), mark), lambda x: x["verdict"].isNotNull())
    best = urls.withColumn("best", F.array_max(fits))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: host, path, rule and verdict of every page's url."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "url"))


SQL = """
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rhost, rpath, v)),
f AS (SELECT page_id, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.k = 1
"""
