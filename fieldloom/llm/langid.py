"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three preceding bytes with symbol counts.  A byte's
probability follows method C: a context gives its symbols c/(T+d) and escapes with d/(T+d) to
the next shorter context (T counts, d of them different), down to a uniform choice of bytes; a
context never seen hands over for nothing.  Statistics are frozen after training, so the code
length of a byte after its context is a constant, in double precision, and a text's exact code
length under each language is the sum over all its bytes.  The shortest code wins.

Trees are sparse: sorted arrays of the contexts and of the byte strings that occur, made for one
language by one task from its counts.  Trained on ``docs_per_language`` labelled documents of each
language (expected number of a hash sample, at any size of the table) and at most
``bytes_per_language`` bytes of each, taken by the same hash, so a tree has at most four entries
of 12 bytes for each of those bytes; the driver holds and broadcasts the trees alone.
Predictions read whole texts.

A null text, or one without a letter, is ``und`` with score 0; so is every text when nothing is
labelled; rows without a doc_id aren't learned from.  Equal code lengths go to the language that sorts first.  A row comes out for each row,
repeated ones and those without a doc_id too.  A long text is one step of its own, in arrays of
some thirty times its size.  Extra columns of any name are ignored.  An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import steps, stored, utf8

DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 1500, 8 << 20
ORDER = 3
#: Bytes of text that the winner's share of probability is given for.
SCORE_BYTES = 4
#: Bytes of text in one step of prediction: enough for strings of bytes to recur.
PREDICT_BYTES = 4 << 20
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: What precedes a text.
_BEFORE = 10


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text, the byte itself in the lowest bits."""
    d = data.astype(np.uint32)
    out = d.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(d), _BEFORE, np.uint32)
        before[k:] = d[:-k]
        for j in range(k):  # the first bytes of a text
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = _BEFORE
        out |= before << np.uint32(8 * k)
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the texts of (lang, text)."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                part = batch.filter(pa.array([x == lang for x in langs]))
                data, offsets = utf8(part.column("text"))
                for lo, hi in steps(offsets):
                    grams, n = np.unique(_grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTree:
    """One language's frozen code lengths.

    For each order, ``strings`` has the contexts with a following byte (the byte in the lowest
    bits) and ``coded`` the bits of that byte there; ``contexts`` and ``escapes`` the contexts and
    the bits of leaving them.
    """

    def __init__(self, strings: list[np.ndarray], coded: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.strings, self.coded, self.contexts, self.escapes = strings, coded, contexts, escapes

    @classmethod
    def train(cls, grams: np.ndarray, counts: np.ndarray) -> "ContextTree":
        parts = [[], [], [], []]
        for k in range(ORDER + 1):
            strings, which = np.unique(grams & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(which, counts)
            contexts, own = np.unique(strings >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(own, n), np.bincount(own)
            base = total + distinct
            for out, x in zip(parts, (strings, np.log2(base[own]) - np.log2(n), contexts, np.log2(base) - np.log2(distinct))):
                out.append(x)
        return cls(*parts)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte after the bytes before it; grams ascend."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            own = grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = self._found(self.strings[k], own)
            hit = at >= 0
            out[left[hit]] += self.coded[k][at[hit]]
            left, own = left[~hit], own[~hit]
            at = self._found(self.contexts[k], own >> np.uint32(8))
            known = at >= 0
            out[left[known]] += self.escapes[k][at[known]]
        out[left] += 8
        return out

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def to_bytes(self) -> bytes:
        arrays = [*self.strings, *self.coded, *self.contexts, *self.escapes]
        return np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.astype(t).tobytes() for x, t in zip(arrays, self._types()))

    @staticmethod
    def _types() -> list:
        return ([np.uint32] * (ORDER + 1) + [np.float64] * (ORDER + 1)) * 2

    @classmethod
    def from_bytes(cls, raw: bytes) -> "ContextTree":
        n, at, arrays = np.frombuffer(raw, np.int64, 4 * (ORDER + 1)), 32 * (ORDER + 1), []
        for size, t in zip(n.tolist(), cls._types()):
            arrays.append(np.frombuffer(raw, t, size, at))
            at += arrays[-1].nbytes
        return cls(*(arrays[i : i + ORDER + 1] for i in range(0, len(arrays), ORDER + 1)))


class PartialMatching:
    """The context trees of all languages."""

    def __init__(self, langs: list[str], trees: list[ContextTree]):
        self.langs, self.trees = langs, trees

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        sums = np.zeros((len(offsets) - 1, len(self.langs)))
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            grams, which = np.unique(_grams(data, offsets), return_inverse=True)
            for i, tree in enumerate(self.trees):
                sums[filled, i] = np.add.reduceat(tree.bits(grams)[which], offsets[:-1][filled])
        return sums


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> PartialMatching | None:
    """A model of the labelled documents (doc_id, text, lang); None without any."""
    usable = labelled.where("doc_id is not null and lang is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    # by language, of which there are few: the share of its documents that is learned from
    share = sizes.select("lang", F.least(F.lit(1.0), docs_per_language / F.col("n"), bytes_per_language / F.col("bytes")).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / F.lit(float(1 << 53))
    part = usable.withColumn("place", place).join(F.broadcast(share), "lang").where("place < share")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = ContextTree.train(pdf["gram"].to_numpy(np.uint32), pdf["n"].to_numpy(np.float64))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "tree": [tree.to_bytes()]})

    trees = stored(gram_counts(part.select("lang", "text")).groupBy("lang").applyInPandas(build, "lang string, tree binary"), "trees")
    rows = sorted(trees.collect())  # a row for each language, of a size that its sample bounds
    return PartialMatching([r["lang"] for r in rows], [ContextTree.from_bytes(bytes(r["tree"])) for r in rows]) if rows else None


def predict(docs: DataFrame, model: PartialMatching | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score.

    The score is the winner's share of probability for an average stretch of ``SCORE_BYTES`` of
    the text (of the whole text where that is shorter).
    """
    # of a size that the samples bound
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column("text")
            data, offsets = utf8(texts)
            for lo, hi in steps(offsets, PREDICT_BYTES):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                letters = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])[at]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = bool(_LETTER.search(texts[lo + int(i)].as_py() or ""))
                if m is None:
                    langs, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                else:
                    bits = m.code_lengths(part, at)
                    best = bits.argmin(1)
                    share = np.exp2((bits.min(1, keepdims=True) - bits) * np.minimum(1.0, SCORE_BYTES / np.maximum(np.diff(at), 1))[:, None])
                    score = np.where(letters, 1 / share.sum(1), 0.0)
                    langs = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
