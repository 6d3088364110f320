"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*  index  bloom  footer

* A block has entries of varints (shared key bytes, further key bytes, value bytes), the
  further key bytes and the value (ids, little-endian, 2 or 4 bytes each), and ends with
  its CRC-32. Each block starts with a whole key, so it can be read alone.
* The sparse index has, per block, its first key, offset, length and the ids of the shard
  before it. A lookup is a binary search in it, then a scan of one block.
* The Bloom filter (10 bits a key, 7 hashes) answers most lookups of absent keys.
* The footer has the places of index and filter, counts, the id width and a magic word.

Keys are document ids as 8 big-endian bytes with the sign flipped, so that byte order is
number order; a null id is the empty key, which comes first.

Documents are range-partitioned by id on the raw text, sorted within each partition in the
JVM (spilling if need be) and encoded while a task streams them into its shard; memory holds
one block, the sparse index and one hash per document. A task writes under a name of its
own attempt and renames at the end, so a lost executor's shard is simply written again.
Every row of the corpus is encoded by the tokenizers library; as its model works on
pre-tokens, ids of short ones are kept in a cache with a fixed number of entries and the
library encodes those that the cache lacks. Texts with unusual characters or special tokens
go through the library as a whole.

Defined results: null or empty text is just the end id; rows that share an id stay separate
entries, in order of their text's digest; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text, shared_dir, worker_state

MAGIC = b"FOLSST01"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
CACHE_ENTRIES, CACHED_CHARS = 150_000, 48
END_ID = 1
SHARD_BYTES = 64 << 20

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
_UNUSUAL = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{_L}]")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def doc_id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    return (low[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64)[None, :] * high[:, None]) % np.uint64(bits)


class Writer:
    """Writes entries in ascending key order to an open file."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.offset = self.docs = self.ids = 0
        self.block, self.first, self.last, self.before = bytearray(), None, b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.width}").tobytes()
        if self.first is None:
            self.first, self.last, self.before = key, b"", self.ids
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.docs += 1
        self.ids += len(ids)
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            raw = bytes(self.block)
            self.out.write(raw + struct.pack("<I", zlib.crc32(raw)))
            self.index.append((self.first, self.offset, len(raw) + 4, self.before))
            self.offset += len(raw) + 4
            self.block, self.first = bytearray(), None

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) + varint(b) for k, o, n, b in self.index)
        bits = max(64, BLOOM_BITS * self.docs)
        flags = np.zeros(bits, np.uint8)
        if self.hashes:
            flags[_bloom_places(np.array(self.hashes, np.uint64), bits).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes()
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), self.docs, self.ids, self.width, MAGIC))
        self.out.close()


class Table:
    """Reads a shard: whole scans and lookups."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.file.seek(bloom_at)
        raw = self.file.read(bloom_size)
        self.bits, self.flags = struct.unpack("<Q", raw[:8])[0], np.frombuffer(raw[8:], np.uint8)
        self.file.seek(index_at)
        raw, at, self.index = memoryview(self.file.read(index_size)), 0, []
        while at < len(raw):
            size, at = read_varint(raw, at)
            key, at = bytes(raw[at : at + size]), at + size
            numbers = []
            for _ in range(3):
                n, at = read_varint(raw, at)
                numbers.append(n)
            self.index.append((key, *numbers))

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, size, _ = self.index[k]
        self.file.seek(offset)
        raw = self.file.read(size)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        view, at, key = memoryview(raw)[:-4], 0, b""
        while at < len(view):
            shared, at = read_varint(view, at)
            more, at = read_varint(view, at)
            size, at = read_varint(view, at)
            key = key[:shared] + bytes(view[at : at + more])
            at += more
            yield key, np.frombuffer(view[at : at + size], f"<u{self.width}")
            at += size

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the shard before it, ids) in order."""
        for k, (_, _, _, before) in enumerate(self.index):
            for key, ids in self._block(k):
                yield doc_id_of(key), before, ids
                before += len(ids)

    def may_have(self, key: bytes) -> bool:
        places = _bloom_places(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64), self.bits)[0].astype(np.int64)
        return bool(((self.flags[places >> 3] >> (places & 7)) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of a document; empty if the shard has none."""
        key = key_bytes(doc_id)
        if not self.may_have(key):
            return []
        firsts = [x[0] for x in self.index]
        out = []
        for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            out += [ids for own, ids in self._block(k) if own == key]
        return out


class WordEncoder:
    """The library's ids of whole texts, with a bounded cache of pre-tokens (two generations)."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # the ids that end a pre-token
        self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of pre-tokens: encoded as one text and cut where ids end a pre-token."""
        out = {}
        for at in range(0, len(pieces), 5000):
            part = pieces[at : at + 5000]
            ids = self._whole(" ".join(part))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                out |= {x: self._whole(x).tobytes() for x in part}
                continue
            raw, start = ids.tobytes(), 0
            for x, stop in zip(part, (4 * stops).tolist(), strict=True):
                out[x] = raw[start:stop]
                start = stop
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        split = {}
        for k, text in enumerate(texts):
            if _UNUSUAL.search(text) or any(x in text for x in self.special):
                out[k] = self._whole(text)
            else:
                split[k] = _FAST.findall(text.lower())
        cache, old = self.cache, self.old
        unknown = set().union(*split.values()).difference(cache)
        if again := unknown.intersection(old):
            cache.update((x, old[x]) for x in again)
        cache.update(self._learn(list(unknown.difference(again))))
        for k, words in split.items():
            out[k] = np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint32)
        for x in unknown:
            if len(x) > CACHED_CHARS:
                del cache[x]
        if len(cache) > CACHE_ENTRIES:
            self.old, self.cache = cache, {}
        return out


def word_encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, for a Python worker."""
    return worker_state(("words", path), lambda: WordEncoder(path))


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about so many bytes, or one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield start, stop
        start = stop


def shard_count(rows: DataFrame) -> int:
    """Shards of some SHARD_BYTES of the input as the planner estimates it, and at least one for each shuffle partition."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, -(-size // SHARD_BYTES))  # no estimate: a huge number


def write_shards(docs: DataFrame, path: str, folder: str, shards: int | None = None, end_id: int | None = END_ID) -> list[dict]:
    """Write the encoded documents as shards below folder; (shard, uri, docs, ids) of each in order."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    shards = shards or shard_count(rows)
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, writer = context.partitionId(), None
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/shard-{shard:06d}.sst"
        own = f"{root}/.shard-{shard:06d}-{context.taskAttemptId()}"
        enc = word_encoder(path)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            if writer is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                writer = Writer(fs.open_output_stream(own), enc.width)
            for start, end in _groups(batch.column(1)):
                ids, texts = (batch.column(k).slice(start, end - start).to_pylist() for k in (0, 1))
                for doc, found in zip(ids, enc.encode(texts), strict=True):
                    writer.add(key_bytes(doc), np.concatenate([found, tail]))
        if writer is not None:
            writer.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [f"{folder}/shard-{shard:06d}.sst"], "docs": [writer.docs], "ids": [writer.ids]})

    found = ordered.mapInArrow(run, "shard long, uri string, docs long, ids long").collect()  # a row for each shard
    return sorted((r.asDict() for r in found), key=lambda r: r["shard"])


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards, start counting over all of them."""
    at, rows = 0, []
    for r in shards:
        rows.append((r["uri"], at))
        at += r["ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part, size = [], 0
                for doc, before, ids in Table(uri).scan():
                    part.append((doc, base + before, ids))
                    size += len(ids)
                    if size >= 1 << 18:
                        yield _rows(part)
                        part, size = [], 0
                if part:
                    yield _rows(part)

    listed = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, ids array<int>")


def _rows(part: list[tuple]) -> pa.RecordBatch:
    lengths = np.cumsum([0, *(len(x[2]) for x in part)]).astype(np.int32)
    flat = pa.array(np.concatenate([x[2] for x in part]).astype(np.int32))
    return pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in part], pa.int64()), "start": pa.array([x[1] for x in part], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(lengths), flat)})


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_shards' rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_path() -> str:
    """The word vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: write every document's ids to shards, read them back and digest them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, default_path(), shared_dir(spark, "tokens"))
    return digests(read_shards(spark, shards))
