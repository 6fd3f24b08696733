"""Exact deduplication by mergeable counting quotient filters.

Every partition builds counting quotient filters of its documents' 64-bit fingerprints, one
for each slice of the fingerprint space.  The filters of a slice are merged by their sorted
remainders, with no loss: a quotient and its remainder give the fingerprint back.
Fingerprints counted more than once route their documents to a comparison of whole texts.

Null texts count as empty; empty texts are equal to each other.  Of equal texts the smallest
doc_id stays, in every row that it has; rows without a doc_id are counted, and stay.  Rows that repeat a doc_id are rows of their own.  Long texts are
normalised and compared whole, by the JVM.  Extra columns of any name are ignored.  An empty table
gives an empty table.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import stored

#: Documents of a slice of the fingerprint space, on average.
SLICE_ROWS = 250_000
#: Repeated fingerprints (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 1 << 20


def _merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct keys as one: nothing is sorted again."""
    at = np.searchsorted(keys, more)
    same = keys[np.minimum(at, len(keys) - 1)] == more if len(keys) else np.zeros(len(more), bool)
    counts = counts.copy()
    counts[at[same]] += more_counts[same]
    return np.insert(keys, at[~same], more[~same]), np.insert(counts, at[~same], more_counts[~same])


class CountingQuotientFilter:
    """Counts of fingerprints that share their ``prefix`` upper bits.

    ``occupied`` has a bit for each quotient, ``run_ends`` one for each slot: the last of its
    quotient's run.  Slots hold remainders in order; counts above one stand in a side list.
    """

    def __init__(self, prefix: int, slice_id: int, quotient_bits: int, occupied, run_ends, remainders, counts):
        self.prefix, self.slice_id, self.q = prefix, slice_id, quotient_bits
        self.occupied, self.run_ends, self.remainders, self.counts = occupied, run_ends, remainders, counts

    @property
    def r(self) -> int:
        return 64 - self.prefix - self.q

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, prefix: int, slice_id: int) -> "CountingQuotientFilter":
        """From sorted distinct fingerprints."""
        q = max(1, math.ceil(math.log2(max(1, len(fingerprints)) / 0.75)))
        rest = fingerprints & np.uint64((1 << 64 - prefix) - 1)
        r = 64 - prefix - q
        quotients = (rest >> np.uint64(r)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
        return cls(prefix, slice_id, q, occupied, run_ends, rest & np.uint64((1 << r) - 1), counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        lengths = np.diff(np.concatenate([[-1], np.flatnonzero(self.run_ends)]))
        quotients = np.repeat(np.flatnonzero(self.occupied), lengths).astype(np.uint64)
        top = np.uint64(self.slice_id << 64 - self.prefix if self.prefix else 0)
        return top | quotients << np.uint64(self.r) | self.remainders

    @classmethod
    def merge(cls, filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        """Merges runs of sorted remainders, two filters at a time; counts of equal remainders under one quotient add up."""
        runs = [(f.fingerprints(), f.counts) for f in filters]
        while len(runs) > 1:
            runs = [_merged(*runs[i], *runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return cls.build(*runs[0], filters[0].prefix, filters[0].slice_id)

    def to_bytes(self) -> bytes:
        width = (self.r + 7) // 8
        more = np.flatnonzero(self.counts > 1)
        parts = (np.packbits(self.occupied), np.packbits(self.run_ends), self.remainders.view(np.uint8).reshape(-1, 8)[:, :width], more.astype(np.uint32), self.counts[more])
        head = struct.pack("<IQIII", self.prefix, self.slice_id, self.q, len(self.remainders), len(more))
        return head + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountingQuotientFilter":
        prefix, slice_id, q, n, n_more = struct.unpack_from("<IQIII", raw)
        at, width = struct.calcsize("<IQIII"), (64 - prefix - q + 7) // 8

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        occupied = np.unpackbits(take(np.uint8, ((1 << q) + 7) // 8), count=1 << q).astype(bool)
        run_ends = np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(np.uint8, n * width).reshape(n, width)
        more, many = take(np.uint32, n_more), take(np.int64, n_more)
        counts = np.ones(n, np.int64)
        counts[more] = many
        return cls(prefix, slice_id, q, occupied, run_ends, remainders.reshape(-1).view(np.uint64), counts)


def normalised(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprint_counts(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of every fingerprint of the column ``fp``, by filters built per partition and merged per slice."""
    prefix = max(4, math.ceil(math.log2(max(1, rows / SLICE_ROWS))))

    def build(batches):
        parts = [np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True) for b in batches if b.num_rows]
        if not parts:
            return
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[heads], np.add.reduceat(counts, heads)
        slices = (keys >> np.uint64(64 - prefix)).astype(np.int64)
        cuts = np.searchsorted(slices, np.arange((1 << prefix) + 1)) if prefix <= 16 else None
        ids = np.unique(slices)
        for s in ids:
            lo, hi = (cuts[s], cuts[s + 1]) if cuts is not None else np.searchsorted(slices, [s, s + 1])
            raw = CountingQuotientFilter.build(keys[lo:hi], counts[lo:hi], prefix, int(s)).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), pa.array([raw], pa.binary())], ["slice", "filter"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(raw) for raw in pdf["filter"]])
        return pd.DataFrame({"fp": merged.fingerprints().view(np.int64), "n": merged.counts})

    return fingerprints.mapInArrow(build, "slice long, filter binary").groupBy("slice").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Three passes over the texts: fingerprints; the texts of repeated fingerprints, grouped byte
    by byte (a partial aggregation, so a large group of copies shrinks before it moves); and
    the digests that carry each group's verdict to its members.
    """
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    base = base.select("doc_id", "norm", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    repeated = stored(fingerprint_counts(base.select("fp"), docs.count()).where("n > 1").select("fp"), "repeated")
    few = repeated.count() <= broadcast_limit
    routed = base.join(F.broadcast(repeated) if few else repeated, "fp", "left_semi")
    groups = routed.groupBy("fp", "norm", "text_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size")).select("fp", "text_sha256", "first_id", "size")
    return (
        base.select("doc_id", "fp", "text_sha256")
        .join(groups, ["fp", "text_sha256"], "left")
        .select("doc_id", F.coalesce("first_id", "doc_id").alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(True)).alias("kept"), "text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """
}
