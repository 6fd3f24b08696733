"""Packing token sequences, shortest pack first, over the histogram of lengths.

Documents are tokenised whole, an end token is added, and each is cut into pieces of the
sequence length and a rest.  The histogram of piece lengths (as many bins as a sequence has
tokens) is packed by itself: lengths are placed longest first, each into the packs that are
shortest so far and have room, as counts of packing patterns.  Patterns join the pieces back
by rank: the k-th piece of a length takes the k-th slot of that length.  Ranks are counted in
salted parts, so a length that many documents share isn't ranked by one task.

Texts are tokenised in groups of ``GROUP_BYTES``: the group's distinct words go to the library
once each, and ids are gathered by the words' numbers.  A longer text is cut at white space
into parts of that size, which changes no id.  This holds for files with ``WORD_RULES``; under
other rules the library gets whole texts.

A null or empty text is the end token alone.  Equal lengths are ranked by doc_id, start and
contents; repeated rows are packed as often as they stand there, a null doc_id too.  Extra
columns of any name are ignored.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import giving_back, steps, stored, utf8

SEQUENCE, END = 4096, 2
#: Bytes of text whose distinct words are tokenised together, and words of one call of the library.
GROUP_BYTES, CALL_WORDS = 8 << 20, 4096
#: Pieces that one task ranks.
RANK_ROWS = 100_000
#: Rules under which words beside white space have ids of their own: fixed values of the tokenizer's file.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORD_END = "</w>"
#: Words of letters up to U+00FF, each of which has one lower-case letter and is composed.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_LOADED: dict[str, "WordTokenizer"] = {}


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, end to end."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


class WordTokenizer:
    """A tokenizer file; where its rules are ``WORD_RULES``, a group's distinct words are tokenised once each.

    Under other rules every text goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.spaced = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words that the rules leave as they are
        self.spaced.normalizer = normalizers.Sequence([])
        self.spaced.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path) as f:
            rules = json.load(f)
        self.by_word = all(rules.get(k) == v for k, v in WORD_RULES.items()) and rules["model"].get("end_of_word_suffix") == WORD_END and not any(re.search(r"\s", t["content"]) for t in rules.get("added_tokens", []))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case Latin words, which are one pre-token each, many to a call; a word's last id is marked as such in the vocabulary."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), CALL_WORDS):
            part = words.slice(lo, CALL_WORDS).to_pylist()
            ids.append(np.array(self.spaced.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32))
            cuts = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(cuts) != len(part):
                raise ValueError("a word's last id isn't marked as such")
            lengths.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and where each word's begin and how many they are."""
        # Latin words, with a comma or full stop or without: the tokenizer lower-cases letters, so case doesn't tell them apart
        stem = pc.ascii_rtrim(words, characters=",.")
        tail = np.asarray(pc.subtract(pc.binary_length(words), pc.binary_length(stem)))
        plain = np.asarray(pc.match_substring_regex(stem, LATIN)) & (tail <= 1)
        stems = pc.utf8_lower(stem.filter(pa.array(plain))).dictionary_encode()
        tails = np.asarray(pc.ends_with(words, pattern=".")) & plain
        ids, lengths = self._letters(stems.dictionary)
        marks = self._each([",", ".", *words.filter(pa.array(~plain)).to_pylist()])
        base, marks_at = np.cumsum(lengths) - lengths, np.cumsum(marks[1]) - marks[1] + len(ids)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.asarray(stems.indices)
        starts[plain], sizes[plain] = base[at], lengths[at]
        starts[~plain], sizes[~plain] = marks_at[2:], marks[1][2:]
        every = np.concatenate([ids, marks[0]])
        tailed = plain & (tail == 1)
        # the ids of a word and of its mark
        which = np.where(tails[tailed], 1, 0)
        both = np.stack([starts[tailed], marks_at[which]], 1).ravel(), np.stack([sizes[tailed], marks[1][which]], 1).ravel()
        sizes[tailed] += marks[1][which]
        starts[tailed] = len(every) + np.cumsum(sizes[tailed]) - sizes[tailed]
        return np.concatenate([every, ragged(every, *both)]), starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the offsets of each (one more than texts); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            ids, lengths = self._each(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        words = pc.ascii_split_whitespace(texts)
        bounds, flat = np.asarray(words.offsets).astype(np.int64), words.flatten()
        filled = np.asarray(pc.not_equal(flat, ""))  # white space at an end leaves an empty word
        kept = np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]
        coded = flat.filter(pa.array(filled)).dictionary_encode()
        del words, flat, filled  # as large as the texts and more
        ids, starts, sizes = self._words(coded.dictionary)
        at = np.asarray(coded.indices)
        each = sizes[at]
        return ragged(ids, starts[at], each), np.concatenate([[0], np.cumsum(each)])[kept]


def _chunks(texts: pa.Array, limit: int) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at white space into parts of about ``limit`` bytes, and the text of each part."""
    out, row = [], []
    for i, text in enumerate(texts):
        raw, at = text.as_py().encode() if text.is_valid else b"", 0
        while len(raw) - at > limit and (m := _SPACE.search(raw, at + limit)):
            out.append(raw[at : m.start()].decode())
            row.append(i)
            at = m.end()
        out.append(raw[at:].decode())
        row.append(i)
    return pa.array(out, pa.large_string()), np.array(row)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END, ids: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of each document's pieces."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * ids

    def of(tokenizer, doc_id, texts):
        """A batch of the pieces of some documents."""
        if (pc.max(pc.binary_length(texts)).as_py() or 0) > group_bytes:
            parts, row = _chunks(texts, group_bytes)
            coded = [tokenizer.encode(parts.slice(i, 1))[0] for i in range(len(parts))]
            found, sizes = np.concatenate(coded), np.bincount(row, [len(x) for x in coded], len(texts)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        else:
            found, offsets = tokenizer.encode(texts)
        found = np.insert(found, offsets[1:], end).astype("<u4")
        offsets = offsets + np.arange(len(offsets))
        total = np.diff(offsets)
        each = -(-total // size)
        which = np.repeat(np.arange(len(total)), each)
        start = (np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)) * size
        length = np.minimum(size, total[which] - start)
        first, raw = offsets[which] + start, memoryview(found).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
        columns = [doc_id.take(pa.array(which)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[which])]
        if ids:  # pieces are found end to end
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(found)), pa.int32()), pa.array(found.view("<i4"))))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        tokenizer = WordTokenizer.load(path)
        held, held_bytes = [], 0

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            doc_id, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
            held.clear()
            return of(tokenizer, doc_id, texts)

        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets, group_bytes):
                if held and held_bytes + offsets[hi] - offsets[lo] > group_bytes:
                    yield done()
                    held_bytes = 0
                held.append(batch.slice(lo, hi - lo))
                held_bytes += int(offsets[hi] - offsets[lo])
        if held:
            yield done()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), schema)


def pack_histogram(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Packing patterns (how often, its lengths) for so many pieces of each length.

    ``free`` has the unfinished patterns by the room they have; the most room is the shortest
    pack.  A pattern of which only some are taken is split in two.
    """
    free: list[list[tuple[int, list[int]]]] = [[] for _ in range(size + 1)]
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left, added, room = histogram[length], [], size
        while left:
            while room >= length and not free[room]:
                room -= 1
            if room < length:
                # new packs, as many of this length in each as fit
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    added.append((full, [length] * each))
                if rest:
                    added.append((1, [length] * rest))
                break
            n, pattern = free[room].pop()
            # as evenly as the pattern's packs allow, as often as there is room
            each = min(room // length, max(1, left // n))
            used = min(n, left // each)
            if used < n:
                free[room].append((n - used, pattern))
            added.append((used, pattern + [length] * each))
            left -= used * each
        for n, pattern in added:
            free[size - sum(pattern)].append((n, pattern))
    return [p for room in free for p in room]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    rows, ranks, base = [], {}, 0
    for n, pattern in patterns:
        at = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            rows.append((length, rank, base, at))
            ranks[length] = rank + n
            at += length
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(parts: DataFrame, size: int = SEQUENCE, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``parts`` (stored; with doc_id, start, length) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    table = slots(pack_histogram(histogram, size))
    salts = max(1, math.ceil(max(histogram.values(), default=0) / rank_rows))
    keyed = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    counts = keyed.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(own)).join(counts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank") - 1).select(*parts.columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def place(batches):
        keys = table[:, 0] << 48 | table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            sequence, offset = table[at, 2] + rank - table[at, 1], table[at, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(stored(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
