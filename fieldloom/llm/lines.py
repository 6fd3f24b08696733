"""Line deduplication by sharded minimal perfect hashes.

Pass one counts, for every distinct line key of each document, the documents that hold it and
the largest of them.  Keys held by enough documents form shards: a minimal perfect hash of
their first hashes over compact arrays of second hashes (fingerprints), counts and last
documents.  Pass two streams the documents' line hashes through their shard's arrays; the
marks return to the documents by doc_id.  A busy shard is copied for several tasks, in
proportion to its load, so no line, however common, goes to one task.  The number of shards
grows with the lines, so a shard's arrays have a size of their own.

A null or empty text is one empty line; what loses nothing keeps its text, a null too.  Rows
of one doc_id are one document: repeated rows count once, and lose the same lines.  Rows
without a doc_id keep all lines and don't count.  Of documents that hold a line, the largest
doc_id keeps it, in every row and at every place where it stands.  A long text is hashed as a
row of its own lines and rebuilt by one task.  Extra columns are ignored by ``dropped_lines`` and
kept by ``drop_repeated_lines``, but for those named as its results, which are replaced.  An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE, giving_back, own_columns, schema_of, stored
from fieldloom.llm.mph import PerfectHash

#: Distinct lines of a shard, on average; lines that one task probes.
SHARD_LINES, TASK_LINES = 100_000, 200_000
#: Shards (12 bytes each) whose loads may be broadcast; more are joined by a shuffle.
BROADCAST_SHARDS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) once for each distinct long enough key of a document."""
    keys = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("k")).select("doc_id", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))
    # only rows that share a doc_id can bring a key twice
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found if repeated.isEmpty() else found.distinct()


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def line_shards(hashes: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """(shard, arrays): for each shard the perfect hash and its arrays, as bytes."""
    counted = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["h1"].to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, pdf = keys[order], pdf.iloc[order]
        fresh = np.append(True, keys[1:] != keys[:-1])
        mph = PerfectHash.build(keys[fresh])
        at = mph.index(keys[fresh])
        n = len(at)
        fp, count, last = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64)
        for column, out in (("h2", fp), ("n", count), ("last", last)):
            out[at] = np.minimum(pdf[column].to_numpy()[fresh], np.iinfo(out.dtype).max)
        # keys that share h1 but not h2: kept beside the arrays
        other = pdf[~fresh][["h1", "h2", "n", "last"]].to_numpy(np.int64)
        raw = mph.to_bytes()
        head = np.array([pdf["shard"].iloc[0], len(raw), n, len(other)], np.int64)
        return pd.DataFrame({"shard": [int(head[0])], "arrays": [b"".join([head.tobytes(), raw, fp.tobytes(), count.tobytes(), last.tobytes(), other.tobytes()])]})

    return counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, arrays binary")


class ShardArrays:
    """A shard's arrays, to be probed by whole arrays of line hashes."""

    def __init__(self, raw: bytes):
        shard, size, n, others = np.frombuffer(raw, np.int64, 4)
        self.shard = int(shard)
        self.mph = PerfectHash.from_bytes(raw[32 : 32 + size])
        at = 32 + int(size)
        self.fp = np.frombuffer(raw, np.int64, n, at)
        self.count = np.frombuffer(raw, np.int32, n, at + 8 * n)
        self.last = np.frombuffer(raw, np.int64, n, at + 12 * n)
        self.other = {(a, b): last for a, b, _, last in np.frombuffer(raw, np.int64, 4 * others, at + 20 * n).reshape(-1, 4).tolist()}

    def drops(self, doc_id: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Where a line is repeated and its document isn't the last that holds it."""
        at = self.mph.index(h1.view(np.uint64))
        known = (at >= 0) & (at < len(self.fp))
        at = np.where(known, at, 0)
        out = known & (self.fp[at] == h2) & (self.last[at] != doc_id)
        for i in np.flatnonzero(known & (self.fp[at] != h2)) if self.other else ():
            last = self.other.get((int(h1[i]), int(h2[i])))
            out[i] = last is not None and last != doc_id[i]
        return out


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_lines: int = SHARD_LINES, task_lines: int = TASK_LINES) -> DataFrame:
    """(doc_id, hashes): the first and second hashes, in pairs, of the line keys that a document loses."""
    hashes = stored(_hashes(docs, min_chars), "lines")
    total = hashes.count()
    shards = max(8, math.ceil(total / shard_lines))
    arrays = stored(line_shards(hashes, min_docs, shards), "shards")
    # shards without repeated lines aren't probed; the others are copied in proportion to their lines
    loads = hashes.groupBy(_shard(shards).alias("shard")).count().join(arrays.select("shard"), "shard", "left_semi")
    loads = stored(loads.select("shard", F.ceil(F.col("count") / task_lines).cast("int").alias("copies")), "loads")
    n = loads.agg(F.sum("copies")).first()[0]
    if not n:
        return docs.sparkSession.createDataFrame([], "doc_id long, hashes array<long>")
    loads = F.broadcast(loads) if shards <= BROADCAST_SHARDS else loads
    none = lambda kind: F.lit(None).cast(kind)
    probes = hashes.withColumn("shard", _shard(shards)).join(loads, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "doc_id", "h1", "h2", none("binary").alias("arrays"))
    blobs = arrays.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), none("long").alias("doc_id"), none("long").alias("h1"), none("long").alias("h2"), "arrays")

    def probe(batches):
        shard = None
        for b in batches:
            shards_, kinds = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = np.unique(np.concatenate([[0, b.num_rows], np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 0) + 1, np.flatnonzero(shards_[1:] != shards_[:-1]) + 1]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if kinds[lo] == 0:
                    shard = ShardArrays(b.column("arrays")[lo].as_py())
                    continue
                assert shard is not None and shard.shard == shards_[lo]
                ids, h1, h2 = (b.column(c).slice(lo, hi - lo).to_numpy() for c in ("doc_id", "h1", "h2"))
                drop = shard.drops(ids, h1, h2)
                if drop.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[drop]), pa.array(h1[drop]), pa.array(h2[drop])], ["doc_id", "h1", "h2"])

    dealt = blobs.unionByName(probes).repartition(n, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    marks = dealt.mapInArrow(giving_back(probe), "doc_id long, h1 long, h2 long")
    return marks.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("h1", "h2"))).alias("hashes"))


RESULTS = ["n_lines", "n_dropped", "kept_sha256"]


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, **sizes) -> DataFrame:
    """``docs`` with its repeated lines dropped from ``text``, and n_lines, n_dropped and kept_sha256."""
    docs = docs.select(*own_columns(docs, RESULTS))
    marks = dropped_lines(docs, min_chars, min_docs, **sizes).select(F.col("doc_id").alias("_fl_id"), F.col("hashes").alias("_fl_hashes"))
    marked = docs.join(marks, F.col("doc_id") == F.col("_fl_id"), "left").drop("_fl_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # which lines go is told by their hashes: only marked documents hash theirs again
    gone = F.when(F.col("_fl_hashes").isNotNull(), F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.xxhash64(line_key(x)))).alias("_fl_lines")
    second = F.when(F.col("_fl_hashes").isNotNull(), F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.xxhash64(F.lit("line"), line_key(x)))).alias("_fl_seconds")
    marked = marked.select("*", gone, second, F.size(lines).cast("long").alias("n_lines"))
    columns = [c for c in docs.columns if c.lower() != "text"]

    def rebuild(batches):
        for b in batches:
            texts, dropped, digests = [], [], []
            for text, hashes, l1, l2 in zip(*(b.column(c).to_pylist() for c in ("text", "_fl_hashes", "_fl_lines", "_fl_seconds"))):
                n = 0
                if hashes and text:
                    gone = set(zip(hashes[::2], hashes[1::2]))
                    all_lines = text.split("\n")
                    kept = [x for x, a, c in zip(all_lines, l1, l2) if (a, c) not in gone]
                    n, text = len(all_lines) - len(kept), "\n".join(kept)
                texts.append(text)
                dropped.append(n)
                digests.append(hashlib.sha256((text or "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string()), b.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], [*columns, "text", *RESULTS])

    return marked.mapInArrow(giving_back(rebuild), schema_of(docs, columns, "text string, n_lines long, n_dropped long, kept_sha256 string"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE_SQL = {
    "op6_line_dedup": f"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        d AS (SELECT k.*, r.key IS NOT NULL AND r.last <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """
}
