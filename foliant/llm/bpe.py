"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

Encoding. For each prefix of a byte string there is one last token such that the prefix's
encoding is that of the shorter prefix plus this token; it is found from earlier prefixes
alone, as the token must be valid after the shorter prefix's last token. A transducer
therefore needs the last tokens of a window of positions only. A token is emitted once it
is stable: once all positions that a later token can start at trace back through it. The
merge list bounds how far that can take: ``Merges.lookahead`` follows, in rank order, how
far to the right of a token its merges can be disturbed by stronger merges. So memory is
constant in the text: the window, the held-back end of the pre-tokenizer's input and a
cache of short pieces with a fixed number of entries.

Pre-tokenizing. Pieces are matched with the byte-level pattern; the last matches of a chunk
are held back until more input decides them. A piece that outgrows a chunk goes on
through the transducer while it is read.

Decoding is a state machine from token bytes to text: bytes of an unfinished character are
kept until the next token; invalid sequences become U+FFFD.

Defined results: null or empty text has no ids and decodes to the empty text; the added
special token in a text is its own id, as the library does by default; repeated rows are
encoded one by one.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, id_and_text, worker_state

CHUNK = 1 << 16
LONG = 1 << 12  # a piece of more characters is passed on while it is still open
CACHED_CHARS = 48
CACHE_ENTRIES = 150_000
PAIR_ENTRIES = 300_000
NEVER = 1 << 60
HOLD = 3  # matches held back at the end of a chunk

# fixed value: the public byte-level pre-tokenizer pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FULL = regex.compile(PATTERN)
# the same over a range of characters whose classes are plain; other texts take the full pattern
_L = "A-Za-zÀ-ÖØ-öø-ſ"
_FAST = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{_L}]")
_GO_ON = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s+(?!\S)|"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Merges:
    """The vocabulary and merge list of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        back = {ord(c): b for b, c in enumerate(byte_symbols())}
        plain = lambda token: bytes(back[ord(c)] for c in token)
        vocab = data["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for token, k in vocab.items():
            self.bytes[k] = plain(token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.base = [vocab[c] for c in byte_symbols()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocab[a], vocab[b]), (k, vocab[a + b]))
        self.lookahead = self._lookahead()
        self.valid: dict[int, bool] = {}
        # right[t], left[t]: the tokens at t's right and left end while it forms, each with the rank
        # that makes it and the rank that takes it up
        self.right = {k: ((k, -1, NEVER),) for k in self.base}
        self.left = dict(self.right)
        for (a, b), (rank, t) in self.rank.items():
            if t not in self.right and a in self.right and b in self.right and not self._crossed(a, b, rank):
                self.right[t] = (*((x, born, min(gone, rank)) for x, born, gone in self.right[b]), (t, rank, NEVER))
                self.left[t] = (*((x, born, min(gone, rank)) for x, born, gone in self.left[a]), (t, rank, NEVER))
        self.ids = {self.bytes[k]: k for k in self.right}  # the tokens that their own bytes encode to
        self.longest = max(map(len, self.ids))
        # the lengths, longest first, of the tokens that end with three given bytes
        ends: dict[bytes, set[int]] = {}
        for raw in self.ids:
            if len(raw) > 2:
                ends.setdefault(raw[-3:], {1, 2}).add(len(raw))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}

    def _lookahead(self) -> int:
        """Bytes behind a token that can still change it, from the merge list alone.

        tail[t]: how far behind t's end something can keep t from forming; stronger[t]: how
        far behind t's end a merge that takes t away, with what decides that merge, reaches.
        """
        tail: dict[int, int] = {}
        stronger: dict[int, int] = {}
        size = [len(x) for x in self.bytes]
        for (a, b), (_, t) in self.rank.items():  # in rank order: only stronger merges are known so far
            reach = max(tail.get(a, 0) - size[b], tail.get(b, 0), stronger.get(b, 0), 0)
            tail[t] = max(tail.get(t, 0), reach)
            stronger[a] = max(stronger.get(a, 0), size[b] + tail[t])
        return max([1, *tail.values(), *stronger.values()])

    def merge(self, raw: bytes) -> list[int]:
        """Plain merging: the best-ranked pair first, leftmost among equals."""
        out = [self.base[b] for b in raw]
        while len(out) > 1:
            best = min((self.rank[p][0] if (p := (out[i], out[i + 1])) in self.rank else NEVER, i) for i in range(len(out) - 1))
            if best[0] == NEVER:
                break
            i = best[1]
            out[i : i + 2] = [self.rank[out[i], out[i + 1]][1]]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand behind token a: their bytes together encode to just them."""
        key = a << 32 | b
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) >= PAIR_ENTRIES:
                self.valid.clear()
            known = self.valid[key] = not self._crossed(a, b, NEVER)
        return known

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank below ``before`` joins a's right end with b's left end."""
        for x, born_x, gone_x in self.right[a]:
            for y, born_y, gone_y in self.left[b]:
                found = self.rank.get((x, y))
                # of equal ranks the leftmost merge comes first
                if found is not None and max(born_x, born_y) < found[0] < min(gone_x, before) and found[0] <= gone_y:
                    return True
        return False


class Transducer:
    """Encodes one piece fed in parts; keeps a window of positions and gives out stable tokens."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.raw = b""  # the window's bytes
        self.last: list[int] = []  # the last token of the prefix that ends behind each byte of the window
        self.before = -1  # the token that was emitted last

    def _extend(self, more: bytes) -> None:
        m, get, last, before = self.m, self.m.ids.get, self.last, self.before
        at, raw, lengths = len(self.raw), self.raw + more, self.m.lengths.get
        fits, known = m.fits, m.valid.get
        for end in range(at + 1, len(raw) + 1):
            for size in lengths(raw[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                if size > end:
                    continue
                token = get(raw[end - size : end])
                if token is not None:
                    prior = last[end - size - 1] if size < end else before
                    if prior < 0:
                        break
                    good = known(prior << 32 | token)
                    if good or good is None and fits(prior, token):
                        break
            last.append(token)
        self.raw = raw

    def _give(self, end: int) -> list[int]:
        """Emit the tokens up to a boundary of the window."""
        out, at = [], end
        while at:
            out.append(self.last[at - 1])
            at -= len(self.m.bytes[out[-1]])
        self.raw, self.last = self.raw[end:], self.last[end:]
        if out:
            self.before = out[0]
        return out[::-1]

    def feed(self, more: bytes) -> list[int]:
        self._extend(more)
        size = len(self.raw)
        if size < 2 * (self.m.lookahead + self.m.longest):
            return []
        ends = set(range(max(0, size - self.m.longest + 1), size + 1))
        while len(ends) > 1:  # trace back all ends from which a later token can start
            top = max(ends)
            ends.remove(top)
            ends.add(top - len(self.m.bytes[self.last[top - 1]]))
        return self._give(ends.pop())

    def finish(self) -> list[int]:
        return self._give(len(self.raw))


class _Cache(dict):
    """Ids, packed, of short pieces; two generations of a fixed size."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.m, self.old = merges, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            t = Transducer(self.m)
            t._extend(piece.encode())
            out = array("I", t.finish()).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Text to packed little-endian ids, for whole texts or for a stream of chunks."""

    def __init__(self, path: str) -> None:
        self.m = Merges(path)
        self.cache = _Cache(self.m)
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.m.special, key=len, reverse=True)) + ")") if self.m.special else None

    def _pieces(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, pieces))

    def _plain(self, text: str) -> bytes:
        if len(text) <= CHUNK:
            pieces = (_FULL if _UNUSUAL.search(text) else _FAST).findall(text)
            if len(text) <= LONG or max(map(len, pieces), default=0) <= LONG:
                return self._pieces(pieces)
        return b"".join(self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)))

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text without special tokens that comes in chunks."""
        held, piece, kind = "", None, ""
        for chunk in chunks:
            held += chunk
            while True:
                if piece is not None:  # a long piece is open: what of the input goes on with it
                    more = _GO_ON[kind].match(held).end()
                    if kind == "S" and more == len(held):
                        more = max(0, more - 1)  # the last white space of a run may belong to the next word
                    part = held[:more]
                    yield array("I", piece.feed(part.encode())).tobytes()
                    held = held[more:]
                    if kind == "S" and len(held) <= 1 or not held:
                        break
                    yield array("I", piece.finish()).tobytes()
                    piece = None
                found = list(_FULL.finditer(held))
                if found and found[-1].end() - found[-1].start() > LONG:
                    yield self._pieces(x[0] for x in found[:-1])
                    text = found[-1][0]
                    kind = "L" if regex.match(r" ?\p{L}", text) else "N" if regex.match(r" ?\p{N}", text) else "O" if regex.match(r" ?[^\s]", text) else "S"
                    piece = Transducer(self.m)
                    yield array("I", piece.feed(text[:-1].encode())).tobytes()
                    held = text[-1:]
                    break
                done = found[:-HOLD]
                yield self._pieces(x[0] for x in done)
                held = held[done[-1].end() :] if done else held
                break
        if piece is not None:
            more = _GO_ON[kind].match(held).end()
            yield array("I", piece.feed(held[:more].encode()) + piece.finish()).tobytes()
            held = held[more:]
        yield self._pieces(x[0] for x in _FULL.finditer(held))

    def encode(self, text: str) -> bytes:
        """Packed little-endian ids of a whole text."""
        if self.split is None or not any(x in text for x in self.m.special):
            return self._plain(text)
        out = []
        for part in self.split.split(text):
            if part in self.m.special:
                out.append(array("I", [self.m.special[part]]).tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)


class Decoder:
    """Token ids to text, a part at a time."""

    def __init__(self, merges: Merges) -> None:
        self.table = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for a Python worker."""
    return worker_state(("bpe", path), lambda: Encoder(path))


def unpack(packed: bytes) -> array:
    out = array("I")
    out.frombytes(packed)
    return out


def decode(enc: Encoder, packed: bytes, part: int = 1 << 16) -> str:
    state, ids = Decoder(enc.m), unpack(packed)
    return "".join([*(state.feed(ids[i : i + part]) for i in range(0, len(ids), part)), state.finish()])


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every row's whole text, and what they decode to."""

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        enc = encoder(path)
        packed = [enc.encode(x) for x in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "ids": pa.array([unpack(x) for x in packed], pa.list_(pa.int32())),
            "decoded": pa.array([decode(enc, x) for x in packed], pa.string()),
        }

    return arrow_map(id_and_text(docs, key, text), each, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without moving ids out of the map."""

    def each(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        enc = encoder(path)
        n, ids, back = [], [], []
        for x in batch.column(1).to_pylist():
            packed = enc.encode(x)
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(decode(enc, packed).encode()).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return arrow_map(id_and_text(docs, key, text), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    """The byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: encode and decode every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())


def tokenized(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids and round_trip (the ids decode to the text); columns of those names are replaced."""
    path = path or default_path()
    base = docs.drop("n_tokens", "ids", "round_trip")
    schema = base.withColumns({"n_tokens": F.lit(None).cast("long"), "ids": F.lit(None).cast("array<int>"), "round_trip": F.lit(None).cast("boolean")}).schema

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            names = batch.schema.names
            texts = [x or "" for x in batch.column(names.index("text")).to_pylist()]
            packed = [enc.encode(x) for x in texts]
            cols = {n: batch.column(k) for k, n in enumerate(names)}
            cols["n_tokens"] = pa.array([len(x) // 4 for x in packed], pa.int64())
            cols["ids"] = pa.array([unpack(x) for x in packed], pa.list_(pa.int32()))
            cols["round_trip"] = pa.array([decode(enc, x) == t for x, t in zip(packed, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict(cols)

    return base.mapInArrow(run, schema)
