"""Quality rules: repetition measures of a text, and lines that many documents of a host share.

Lines are normalised (white space stripped at both ends, A-Z lower-cased) and hashed.  For each
host, the distinct documents that hold a line are counted, at every size of the host by the same
limit.  Lines above it are removed; a document that this depletes is rejected, as is one that
fails the base rules.  The document with a line's smallest doc_id in a host keeps that line, so
the last copy of a passage is never lost; of many copies of a document the first is left whole.

Null and empty texts have no words and fail the base rules.  A null host is a host of its own.
Rows of one doc_id are one document in the count, and each is judged by its own text and host;
repeated rows are judged alike, and equal lines of a text all go.  Rows without a doc_id are
judged by the base rules alone.  A long text is measured whole by one task.  Extra columns are
ignored by ``quality_rules``; ``cleaned`` keeps them, but for those named as its results, which
are replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import giving_back, mix, own_columns, prefix_hashes, schema_of, span_hashes, steps, stored, utf8, words

#: A line is shared when more documents of its host hold it.
LINE_DOCS = 20
#: A document is depleted when less than this percentage of its words is left.
LEFT_PERCENT = 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*COUNTS, "base_failed", "kept", "n_shared_words"]


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts of each text, and for lines with a word: their row, the hash of their key and their words."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    raw, low = prefix_hashes(data), prefix_hashes(_LOWER[data])
    out = {"n_words": np.diff(first), "n_symbols": _per_row(_SYMBOL[data], offsets)}
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = np.diff(np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])[first])
    # words in repeated windows of three
    hashes = span_hashes(raw, starts, ends)
    n = len(starts)
    whole = np.flatnonzero(row_of_word[2:] == row_of_word[:-2]) if n > 2 else np.zeros(0, np.int64)
    keys = mix(hashes[whole] * np.uint64(3) + mix(hashes[whole + 1]) * np.uint64(5) + mix(hashes[whole + 2] + np.uint64(1)) * np.uint64(7) + mix(row_of_word[whole].astype(np.uint64)))
    again = whole[_repeated(keys)]
    covered = np.zeros(n + 3, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + 3, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(covered)[:n] > 0, first)
    lines = _Lines(data, low, offsets, starts, ends)
    own = mix(span_hashes(raw, lines.starts, lines.ends) ^ mix(lines.row.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    later = np.zeros(len(own), bool)
    later[order[1:]] = own[order[1:]] == own[order[:-1]]
    out["n_dup_lines"] = np.bincount(lines.row[later], minlength=rows)
    return out, lines.row, lines.key, lines.words


class _Lines:
    """The lines that have a word: their row, bytes, number of words and the hash of their key."""

    def __init__(self, data: np.ndarray, low: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        order = np.lexsort((starts, row))
        starts, row = starts[order], row[order]
        last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
        ends = np.where(last, offsets[row + 1], np.append(starts[1:], 0) - 1)
        a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
        full = b > a
        self.starts, self.ends, self.row, a, b = (x[full] for x in (starts, ends, row, a, b))
        self.words, self.key = b - a, span_hashes(low, word_starts[a], word_ends[b - 1])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Where a key occurs more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]] if len(keys) else np.zeros(0, bool)
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _content(text, host) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text, F.coalesce(F.concat(F.lit("="), host), F.lit("")))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, a hash of text and host, the counts, and the lines with their words (equal lines of a row as one)."""
    lines = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                counts, row, h, w = measures(part, at)
                order = np.lexsort((h, row))
                row, h, w = row[order], h[order], w[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                total = np.add.reduceat(w, new) if len(new) else w
                bounds = np.searchsorted(row[new], np.arange(hi - lo + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(total.astype(np.int64))], fields=list(lines.value_type))
                b = batch.slice(lo, hi - lo)
                arrays = [b.column("doc_id"), b.column("host"), b.column("content"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "host", "content", *COUNTS, "lines"])

    host_ = F.col(host).cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_.alias("host"), _content(F.col("text"), host_).alias("content"), "text")
    return given.mapInArrow(giving_back(run), "doc_id long, host string, content long, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<h: bigint, w: bigint>>")


def _judged(docs: DataFrame, host: str, line_docs: int, left_percent: int) -> DataFrame:
    """doc_id, content, the counts, base_failed, kept, n_shared_words, and ``gone``, the hashes of the lines removed, of every row."""
    m = stored(measured(docs, host).withColumn("row", F.monotonically_increasing_id()), "measures")
    key = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    lines = m.where("doc_id is not null").select("row", "doc_id", key.alias("host"), F.explode("lines").alias("line")).select("row", "doc_id", "host", "line.h", "line.w")
    # documents, not rows: a doc_id counts once for a line of a host
    holders = lines.groupBy("host", "h", "doc_id").agg(F.lit(1).alias("one"))
    shared = holders.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > line_docs).select("host", "h", "first")
    removed = lines.join(shared, ["host", "h"]).where("doc_id <> first").groupBy("row").agg(F.sum("w").alias("n_shared_words"), F.collect_list("h").alias("gone"))
    out = m.drop("lines", "host").join(removed, "row", "left").withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = out.withColumn("base_failed", failed)
    depleted = (F.col("n_words") - F.col("n_shared_words")) * 100 < F.col("n_words") * left_percent
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "content", *RESULTS, "gone")


def quality_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and n_shared_words (words of the lines removed)."""
    return _judged(docs, host, line_docs, left_percent).select("doc_id", *RESULTS)


def cleaned(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """``docs`` with the lines above the limit removed from ``text``, and the columns of ``quality_rules``.

    Verdicts meet their rows by doc_id and a hash of text and host: rows that are equal in these are judged alike.
    """
    docs = docs.select(*own_columns(docs, RESULTS))
    verdicts = _judged(docs, host, line_docs, left_percent).dropDuplicates(["doc_id", "content"])
    verdicts = verdicts.select(F.col("doc_id").alias("_fl_id"), F.col("content").alias("_fl_content"), *(F.col(c).alias(f"_fl_{c}") for c in RESULTS), F.col("gone").alias("_fl_gone"))
    given = docs.withColumn("_fl_own", _content(F.col("text"), F.col(host).cast("string")))
    joined = given.join(verdicts, F.col("doc_id").cast("long").eqNullSafe(F.col("_fl_id")) & (F.col("_fl_own") == F.col("_fl_content")))
    columns = [c for c in docs.columns if c.lower() != "text"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                gone = b.column("_fl_gone")
                texts = [without_lines(t, set(g)) if g and t else t for t, g in zip(b.column("text").to_pylist(), gone.to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string()), *(b.column(f"_fl_{c}") for c in RESULTS)], [*columns, "text", *RESULTS])

    types = dict(verdicts.dtypes)
    return joined.mapInArrow(giving_back(run), schema_of(docs, columns, "text string, " + ", ".join(f"{c} {types[f'_fl_{c}']}" for c in RESULTS)))


def without_lines(text: str, gone: set[int]) -> str:
    """``text`` without the lines whose key has one of these hashes."""
    data = np.frombuffer(text.encode(), np.uint8)
    low, offsets = _LOWER[data], np.array([0, len(data)])
    starts, ends, _ = words(data, offsets)
    lines = _Lines(data, prefix_hashes(low), offsets, starts, ends)
    drop = set(lines.starts[np.isin(lines.key.view(np.int64), np.fromiter(gone, np.int64, len(gone)))].tolist())
    kept, at = [], 0
    for line in data.tobytes().split(b"\n"):
        if at not in drop:
            kept.append(line)
        at += len(line) + 1
    return b"\n".join(kept).decode()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = {
    "op9_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
        i AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
        k AS (SELECT doc_id, i, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM i WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM k WHERE z IS NOT NULL),
        again AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, source, text, unnest(string_split(t, chr(10))) AS line FROM d),
        lw AS (SELECT *, translate(trim(line, {_SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lw GROUP BY doc_id, line) GROUP BY doc_id),
        shared AS (SELECT lw.source, key, min(doc_id) AS first FROM lw GROUP BY lw.source, key HAVING count(DISTINCT doc_id) > {LINE_DOCS}),
        gone AS (SELECT doc_id, sum(n) AS n FROM lw JOIN shared ON shared.source IS NOT DISTINCT FROM lw.source AND shared.key = lw.key WHERE doc_id <> first GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_shared_words
            FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id)),
        v AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_words - n_shared_words) * 100 >= n_words * {LEFT_PERCENT} AS kept, n_shared_words FROM v
    """
}
