"""Secret scans with DataFrame functions only.

Base kinds are found by patterns: ``assign`` (a credential word, a separator and a value),
``access`` (key identifiers) and ``hex`` (long lower-case hexadecimal runs). Spans come from
splitting the text at a pattern: the lengths of the parts between matches and of the matches
themselves give every start, so no code leaves the JVM. Starts are prefix sums, made in
log2(matches) passes, so a text of very many matches (a dump of keys) costs no square of them.

The method adds ``entropy`` spans. Candidates are runs of at least ``window`` characters of a
token alphabet in what base spans leave of the text, so a secret glued to one is tested on its
own. Over each a window of ``window`` characters slides; the counts of its character symbols
are kept incrementally (one enters, one leaves) and with them S = sum of c * log2(c), so the
window's Shannon entropy is log2(w) - S / w. The maximal window entropy of a candidate is
compared with the limit of its character class, the narrower of hexadecimal and base64 that
holds it. Candidates are suppressed where an allow-list pattern matches them or where they have
no digit or no letter.

Defined results: null or empty text has no spans; spans count code points, ends exclusive;
repeated rows are scanned one by one; an empty table gives an empty result; texts of any length
are scanned whole; columns of the output's names are replaced, all others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs shorter than these fail as a whole, wherever a match starts in them, so the length is in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Identifiers that look random but are public by their form: UUIDs, placeholders, paths, one character repeated.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)(?:^|[^a-z0-9])(?:examples?|samples?|placeholder|dummy|tests?)(?:[^a-z0-9]|$)",
    r"^/{0,2}(?:[A-Za-z_-]+[0-9]{0,4}|[0-9]+)(?:/{1,2}(?:[A-Za-z_-]+[0-9]{0,4}|[0-9]+))+/?$",
    r"^(?<one>.)\k<one>+$",
)


@dataclass(frozen=True)
class Limits:
    window: int = 20
    hex_bits: float = 3.0
    base64_bits: float = 3.8
    allow: tuple[str, ...] = ALLOW


_SPANS = "array<struct<s:int,e:int,k:int,t:string>>"


def running_sums(numbers: Column) -> Column:
    """Prefix sums of an array of integers, in some log2(size) passes of adding the array to itself, moved on."""
    size = F.size(numbers)
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(size)).cast("int") - 1, F.lit(0)))

    def add(acc: Column, k: Column) -> Column:
        by = F.least(F.pow(F.lit(2), k).cast("int"), F.size(acc))
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, 1, F.size(acc) - by)), lambda x, y: x + y)

    return F.aggregate(rounds, numbers, add)


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, end, kind, text) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running_sums(F.zip_with(between, found, lambda x, y: F.length(x) + F.length(y)))
    out = F.zip_with(ends, found, lambda e, t: F.struct((e - F.length(t)).alias("s"), e.alias("e"), F.lit(kind).alias("k"), t.alias("t")))
    # only a text that has a match is split
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(_SPANS))


def masked(text: Column, pattern: str, counts: Callable[[Column], Column]) -> Column:
    """The text with spaces for every character of the matches that count."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.when(counts(x), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    between = F.split(text, pattern, -1)
    whole = F.array_join(F.transform(F.arrays_zip(between.alias("0"), found.alias("1")), lambda x: F.concat(x["0"], F.coalesce(x["1"], F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def window_entropy(text: Column, window: int) -> Column:
    """The largest Shannon entropy (bits a character) of any window of a candidate."""
    codes = F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])  # c * log2(c) for c = 0..

    def f(c: Column) -> Column:
        return F.element_at(weight, c + 1)

    def step(acc: Column, i: Column) -> Column:
        enters = F.element_at(acc["codes"], i)
        leaves = F.when(i > window, F.element_at(acc["codes"], F.greatest(i - window, F.lit(1))))
        n_in = F.element_at(acc["counts"], enters)
        s = acc["s"] + f(n_in + 1) - f(n_in)
        n_out = F.element_at(acc["counts"], leaves) + (leaves == enters).cast("int")
        s = F.when(leaves.isNull(), s).otherwise(s + f(n_out - 1) - f(n_out))
        counts = F.transform(acc["counts"], lambda c, k: c + (k + 1 == enters).cast("int") - F.coalesce((k + 1 == leaves).cast("int"), F.lit(0)))
        best = F.when(i >= window, F.greatest(acc["best"], F.lit(math.log2(window)) - s / window)).otherwise(acc["best"])
        return F.struct(acc["codes"].alias("codes"), counts.alias("counts"), s.alias("s"), best.alias("best"))

    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda acc: acc["best"])


def _long_value(match: Column) -> Column:
    """Whether an assign match counts."""
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What follows from a value that is computed a single time, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _entropy_spans(text: Column, limits: Limits) -> Column:
    rest = once(text, lambda t: masked(t, ASSIGN, _long_value))
    rest = once(rest, lambda t: masked(t, ACCESS, lambda x: F.lit(True)))
    rest = once(rest, lambda t: masked(t, HEX, lambda x: F.lit(True)))
    found = once(rest, lambda t: spans(t, f"[A-Za-z0-9+/_-]{{{limits.window},}}={{0,2}}", KINDS.index("entropy")))
    plausible = F.filter(found, lambda x: x["t"].rlike("[0-9]") & x["t"].rlike("[A-Za-z]"))
    if limits.allow:
        allowed = "|".join(f"(?:{p})" for p in limits.allow)
        plausible = F.filter(plausible, lambda x: ~x["t"].rlike(allowed))

    def random(x: Column) -> Column:
        limit = F.when(x["t"].rlike("^[0-9a-fA-F]+$"), F.lit(limits.hex_bits)).otherwise(F.lit(limits.base64_bits))
        return window_entropy(x["t"], limits.window) >= limit

    return F.filter(plausible, random)


def scanned(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """docs with ``base`` and ``added``: sorted arrays of (s, e, k, t), k counting KINDS from 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(spans(body, ASSIGN, 0), lambda x: _long_value(x["t"]))

    def ordered(x: Column) -> Column:
        byplace = F.array_sort(F.transform(x, lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e"), y["t"].alias("t"))))
        return F.transform(byplace, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["k"].alias("k"), y["t"].alias("t")))

    based = docs.withColumn("base", ordered(F.concat(assign, spans(body, ACCESS, 1), spans(body, HEX, 2))))
    return based.withColumn("added", ordered(_entropy_spans(body, limits)))


def joined_spans(found: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then by kind."""
    name = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs."""
    found = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts and digests of the spans of every document."""
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet"))
