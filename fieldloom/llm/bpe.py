"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as
they stand.  Tier two, for the others: bytes as a linked list, and a heap of adjacent pairs by
rank and place; the best pair merges until none is left.  Results equal the greedy lowest-rank
merge of public byte-level BPE libraries.

Null texts encode to no ids, as do empty ones.  Each document is encoded whole, a long one by one
task; of pairs of one rank the leftmost merges first.  Repeated rows are encoded each, as are those
without a doc_id.  Extra columns are kept, but for those named as results, which are replaced;
``round_trip`` ignores them.  An empty table gives an empty table.  A memo in front of both tiers
keeps what a worker has resolved, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import prefix_hashes, span_hashes
from fieldloom.llm.mph import PerfectHash

#: Pre-tokens that a worker remembers; ``round_trip`` forgets them with each task.
MEMO = 600_000
#: Characters of a text whose pre-tokens aren't held all at once.
LONG_CHARS = 4 << 20
_LOADED: dict[tuple[str, str], "BytePairCodec"] = {}


def _span_keys(pieces: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.append(0, ends[:-1]).astype(np.int64)
    return span_hashes(prefix_hashes(np.frombuffer(b"".join(pieces), np.uint8)), starts, ends.astype(np.int64))


class BytePairCodec:
    """Encoder and decoder for a file of ranks (a base64 token and its rank on each line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {r: t for t, r in self.ranks.items()}
        tokens = list(self.ranks)
        keys = _span_keys(tokens)
        self.mph = PerfectHash.build(keys)
        self.slots: list[tuple[bytes, bytes]] = [(b"", b"")] * len(tokens)
        for at, t in zip(self.mph.index(keys).tolist(), tokens):
            self.slots[at] = (t, self.ranks[t].to_bytes(4, "little"))
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> "BytePairCodec":
        """One codec for each worker process."""
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(path, pattern)
        return _LOADED[path, pattern]

    def merge(self, piece: bytes) -> bytes:
        """Tier two: ids of a pre-token, as little-endian 32-bit integers."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return ranks[piece].to_bytes(4, "little")
        following, previous = list(range(1, n + 1)), list(range(-1, n))
        pair = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            best = heappop(heap)
            i = best & 0xFFFFFFFF
            if pair[i] != best >> 32:  # that pair is gone
                continue
            j = following[i]
            k = following[j]
            following[i], previous[k], pair[j] = k, i, -1
            r = ranks.get(piece[i : following[k]], -1) if k < n else -1
            pair[i] = r
            if r >= 0:
                heappush(heap, r << 32 | i)
            p = previous[i]
            if p >= 0:
                r = ranks.get(piece[p:k], -1)
                pair[p] = r
                if r >= 0:
                    heappush(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : following[i]]].to_bytes(4, "little"))
            i = following[i]
        return b"".join(out)

    def learn(self, fresh: list[str]) -> None:
        """Resolves pre-tokens that the memo lacks: all by the perfect hash at once, the rest by merging."""
        pieces = [t.encode() for t in fresh]
        for t, piece, at in zip(fresh, pieces, self.mph.index(_span_keys(pieces)).tolist()):
            token, packed = self.slots[at] if at >= 0 else (b"", b"")
            self.memo[t] = packed if token == piece else self.merge(piece)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        if any(t and len(t) > LONG_CHARS for t in texts):
            return [self._long(t) if t and len(t) > LONG_CHARS else self.encode([t])[0] for t in texts]
        return self._joined([self.pattern.findall(t) if t else [] for t in texts])

    def _long(self, text: str) -> bytes:
        """Ids of a long text, of which some pre-tokens at a time are held."""
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while part := list(islice(found, LONG_CHARS // 4)):
            out += self._joined([part])
        return b"".join(out)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        """Ids of texts given by their pre-tokens."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list(set().union(*split).difference(self.memo))
        if fresh:
            self.learn(fresh)
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian 32-bit ids stand for; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _slices(batch: pa.RecordBatch, rows: int = 256):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the array of ids of ``column`` in ``into`` (which replaces a column of that name)."""
    rest = [f for f in df.schema if f.name != into]

    def run(batches):
        codec = BytePairCodec.load(path, pattern)
        for batch in batches:
            for b in _slices(batch):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(b.column(column).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(ids, pa.list_(pa.int32()))], [*(f.name for f in rest), into])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{into}` array<int>"]))


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids of ``column`` stand for in ``into``; null for null."""
    rest = [f for f in df.schema if f.name != into]

    def run(batches):
        codec = BytePairCodec.load(path, pattern)
        for b in batches:
            out = [None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(out, pa.binary())], [*(f.name for f in rest), into])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{into}` binary"]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256; encoder and decoder in one pass, so ids never leave the worker."""

    def run(batches):
        codec = BytePairCodec.load(path, pattern)
        for batch in batches:
            for b in _slices(batch):
                ids = codec.encode(b.column("text").to_pylist())
                digests = [hashlib.sha256(x).hexdigest() for x in ids]
                decoded = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.memo.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
