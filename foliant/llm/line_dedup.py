"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z lowered; keys of at
least ``min_chars`` code points count. For every key the runs hold how many documents have
it and the largest of their ids. Work goes in batches, as it would when a corpus arrives in
parts:

1. a batch's lines are hashed in Arrow batches (128 bits, so that equal hashes mean equal
   keys) and summed per hash, with a map-side sum first;
2. the batch is merge-joined with the runs: hashes that no run knows (those that an anti-join
   would leave) are marked fresh, others as increments, and both become the new level-0 run;
3. as soon as ``fanout`` runs of one level exist they are merged into one of the next level.

A run is a table in the shared folder, hashed into a fixed number of buckets and sorted by
hash within each, so merges and joins between runs and batches need no shuffle of the runs.
With every batch applied, a last merge gives the keys of at least ``min_docs`` documents,
which are joined with the lines; AQE splits the join's hot keys, whose rows are only
(hash, document) pairs.

Defined results: null or empty text is one empty line, which is never dropped; a key held
by several rows with one doc_id counts that document once, and each of them is treated alike;
rows with a null doc_id stay whole; an empty table gives an empty result; texts and lines of any
length are taken whole; other columns may have any names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, forget, id_and_text, shared_dir, written

_SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Config:
    min_chars: int = 20
    min_docs: int = 3
    batches: int = 4
    fanout: int = 2


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None for a short one."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, config: Config) -> DataFrame:
    """(h, doc_id, batch): the distinct long keys of each row of (doc_id, text)."""

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array] | None:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {line_hash(x, config.min_chars) for x in text.encode().split(b"\n")}
            found.discard(None)
            hashes.extend(found)
            ids.extend([doc] * len(found))
        return {"h": pa.array(hashes, pa.binary()), "doc_id": pa.array(ids, pa.int64())} if ids else None

    return arrow_map(docs, each, "h binary, doc_id long").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(config.batches)).cast("int"))


@dataclass
class Runs:
    """The levelled runs: bucketed, sorted tables (h, n, last, fresh).

    ``fresh`` marks the run that held the key first, so every key has one fresh row in all
    runs together, and a batch needs to be anti-joined with fresh rows alone.
    """

    spark: SparkSession
    buckets: int
    fanout: int
    levels: dict[int, list[str]] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)

    def _save(self, df: DataFrame) -> str:
        name, path = f"run_{uuid.uuid4().hex}", shared_dir(self.spark, "line-run")
        df.select("h", "n", "last", "fresh").write.option("path", path).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.paths[name] = path
        return name

    def tables(self) -> list[str]:
        return [t for k in sorted(self.levels) for t in self.levels[k]]

    def rows(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for x in names[1:]:
            out = out.unionByName(self.spark.table(x))
        return out

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's sums (h, n, last) with the runs and add what it brings."""
        new = batch
        names = self.tables()
        for k, name in enumerate(names):
            new = new.join(self.spark.table(name).where("fresh").select("h", F.lit(True).alias(f"in_{k}")), "h", "left")
        known = F.coalesce(*[F.col(f"in_{k}") for k in range(len(names))], F.lit(False))
        self.levels.setdefault(0, []).append(self._save(new.withColumn("fresh", ~known)))
        self.compact()

    def compact(self) -> None:
        """Merge ``fanout`` runs of a level into one of the next, level by level."""
        level = 0
        while len(names := self.levels.get(level, [])) >= self.fanout:
            merged = self.rows(names).groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))
            self.levels.setdefault(level + 1, []).append(self._save(merged))
            self.levels[level] = []
            self.drop(names)
            level += 1

    def repeated(self, min_docs: int) -> DataFrame:
        """(h, last) of the keys of at least so many documents over all runs."""
        rows = self.rows(self.tables()).groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return rows.where(F.col("n") >= min_docs).select("h", "last")

    def drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")
            forget(self.spark, self.paths.pop(x))


def repeated_lines(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, hashes): for each document the keys whose lines it loses; docs is (doc_id, text)."""
    spark = docs.sparkSession
    path = shared_dir(spark, "line-keys")
    line_keys(docs.where("doc_id IS NOT NULL"), config).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("h binary, doc_id long, batch int").parquet(path)
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), config.fanout)
    for k in range(config.batches):
        # count(distinct) by a first grouping: rows that share a doc_id count as one document
        once = lines.where(F.col("batch") == k).groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
        runs.add(once.groupBy("h").agg(F.count("one").alias("n"), F.max("doc_id").alias("last")))
    repeated = written(runs.repeated(config.min_docs), "line-repeated")
    runs.drop(runs.tables())
    lost = lines.select("h", "doc_id").join(repeated, "h").where("doc_id <> last")
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))


def kept_lines(text: str, hashes: set[bytes], min_chars: int) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = text.split("\n")
    if not hashes:
        return lines, len(lines)
    return [x for x in lines if line_hash(x.encode(), min_chars) not in hashes], len(lines)


def deduplicated(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row of docs with what is left of its text."""
    rows = id_and_text(docs)
    joined = rows.join(repeated_lines(rows, config), "doc_id", "left")

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, n, dropped = [], [], []
        for text, hashes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, total = kept_lines(text, set(hashes or ()), config.min_chars)
            texts.append("\n".join(kept))
            n.append(total)
            dropped.append(total - len(kept))
        return {"doc_id": batch.column(0), "text": pa.array(texts, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}

    return arrow_map(joined.select("doc_id", "text", "hashes"), each, "doc_id long, text string, n_lines long, n_dropped long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: lines before and after, and a digest of the kept text, per document."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def dedup_rows(spark: SparkSession, docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs with its texts rewritten; the other columns as they are, n_chars following the text.

    Rows travel as one struct, so no name of a column can clash; a null text stays null.
    """
    lost = repeated_lines(id_and_text(docs), config)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    joined = rows.join(lost, "doc_id", "left").select("row", "hashes")

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            cols = dict(zip(row.type.names, row.flatten(), strict=True))
            texts, lengths = [], []
            for text, hashes in zip(cols["text"].to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = text if text is None or not hashes else "\n".join(kept_lines(text, set(hashes), config.min_chars)[0])
                texts.append(new)
                lengths.append(None if new is None else len(new))
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array(lengths, cols["n_chars"].type)
            yield pa.RecordBatch.from_pydict(cols)

    return joined.mapInArrow(run, docs.schema)


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, (r.key IS NOT NULL AND k.doc_id <> r.last) AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
