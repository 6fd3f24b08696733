"""Repeated-passage removal by merging shard Burrows-Wheeler transforms.

Finds every byte covered by a string of ``length`` bytes that also starts earlier (at a smaller
doc_id, or in the same document at a smaller offset).

1. Each window of ``length`` bytes is keyed by the least hash of its ``GRAM``-byte substrings,
   so equal windows have equal keys.  Neighbouring windows of one key form a piece; a document
   has about one piece for each thirty-five bytes.
2. Pieces meet by key.  A key met once has no repeated window.  Of equal pieces the earliest
   stands for all, and the others are repeated throughout.  This is done first within every
   ``FLUSH_PIECES`` pieces of a task, so of a text that very many documents hold few pieces
   meet.  A key that has over ``WIDE_TEXTS`` texts among those is wide: its pieces meet by
   their text, all of them count as differing, and a row without a document tells the others.
3. Where a key has pieces that differ, their distinct texts are divided into shards.  Each
   shard's suffixes are sorted to the depth ``length`` and give its Burrows-Wheeler transform.
   The transforms are merged by refining their interleave: each round stably sorts the current
   interleave by the merged transform's symbols, two at a time, which orders all suffixes by
   two more of their first symbols without comparing them again.  The round in which a
   boundary first shows tells a common prefix; the blocks left when ``length`` symbols are
   sorted are the repeated intervals.
   A key of very many differing texts, as of a line that a third of all documents hold, doesn't
   become one group: each of its windows stands for itself.  Those whose hash no other of them has
   are left out, as nothing equals them; the others are dealt by their own text.  Of equal ones
   among ``HELD_WINDOWS`` differing windows a task deals the earliest alone and marks the others;
   marks meet by their place, in as many groups as their number asks for, not with the few texts.
4. The earliest window of each block stays, the others are marked, and marks meet the
   documents by doc_id.

A null or empty text has no bytes; texts shorter than ``length`` bytes lose nothing.  Repeated
rows (of one doc_id and text) are one document: each loses what that document loses.  Rows of
one doc_id whose texts differ are documents of their own, in the order of a hash of their texts.
Rows without a doc_id keep all they have.  Of equal places the smallest doc_id's stays, within a
document the first.  Matches never cross documents.  Bytes are removed wherever they are marked,
which may leave part of a character: ``kept_sha256`` counts it, ``kept_text`` leaves it out.  A
long text is worked on whole by one task, in arrays of some ten times its size.  Extra columns
are ignored, or kept by ``remove_repeats`` but for those named as its results, which are
replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import STEP_BYTES, give_back, giving_back, mix, own_columns, powers, prefix_hashes, schema_of, span_hashes, steps, stored, utf8

LENGTH, GRAM = 100, 32
#: Pieces that one task matches, and bytes of differing pieces whose transforms are merged as one: few enough
#: for a processor's cache, in which the merge's stable sorts take half the time.
TASK_PIECES, GROUP_BYTES = 300_000, 24 << 10
SHARDS = 2
#: Busy keys (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20
#: Differing pieces of one key that are merged as one group; of more, each window is a piece of its own, dealt by its text.
GROUP_PIECES = 5_000
#: Pieces that a task reduces before they are dealt, and the most texts of one key among them that are dealt by their key.
FLUSH_PIECES, WIDE_TEXTS = 200_000, 16
#: Differing windows of busy keys (100 bytes each) that a task holds to reduce equal ones.
HELD_WINDOWS = 100_000
#: Marks of busy keys that one task makes runs of, and the bits of a place within a stretch whose marks meet.
TASK_MARKS, STRETCH_BITS = 10_000, 12
_MOST = np.uint64((1 << 64) - 1)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """row, start in the row, windows, key, content hash and whether its key stands in it twice, of each piece."""
    n, span = len(data), length - gram + 1
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    if n < length:
        return nothing
    prefix = prefix_hashes(data)
    grams = mix((prefix[gram:] - prefix[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    m = len(grams)
    # the upper bits of a hash above its place: the least is the leftmost of equal hashes
    bits = np.uint64(m.bit_length())
    ranked = np.full(-(-m // span) * span, _MOST)
    np.bitwise_or(grams >> bits << bits, np.arange(m, dtype=np.uint64), out=ranked[:m])
    blocks = ranked.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - span + 1], ahead[span - 1 : m])  # of the window at each byte
    sizes = np.diff(offsets)
    at = np.flatnonzero(np.arange(len(least)) + length <= np.repeat(offsets[1:], sizes)[: len(least)])
    if not len(at):
        return nothing
    least = least[at]
    # runs of one place, then pieces of one key and text
    turns = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
    keys = grams[(least[turns] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
    rows = np.searchsorted(offsets, at[turns], "right") - 1
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])
    first = np.flatnonzero(new)
    heads = turns[first]
    windows = np.diff(np.append(heads, len(at)))
    begin, key, row = at[heads], keys[first], rows[first]
    content = span_hashes(prefix, begin, begin + windows + length - 1)
    # equal windows of a piece have their least hash at different places
    twice = np.diff(np.append(first, len(turns))) > 1
    return row, begin - offsets[row], windows, key, content, twice


#: kind: bits for a key that stands twice, a piece that an earlier one covers, a wide key's piece, and a row that tells of one.
_COLUMNS = [("key", np.uint64), ("content", np.uint64), ("doc", np.int64), ("start", np.int64), ("windows", np.int32), ("kind", np.int8)]
_TWICE, _COVERED, _WIDE, _TELLS = 1, 2, 4, 8


def _ordered(key, content, doc, start, windows, kind):
    """The columns by key, content and place, and where a key and a text begin."""
    order = np.lexsort((start, doc, content, key))
    columns = [c[order] for c in (key, content, doc, start, windows, kind)]
    key, content = columns[:2]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    return columns, new_key, new_key | np.concatenate([[True], content[1:] != content[:-1]])


def _reduced(columns: list[np.ndarray], wide_texts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """What the pieces are dealt by, and the pieces: all but the first of equal ones are covered, and wide keys are told of."""
    (key, content, doc, start, windows, kind), new_key, new_text = _ordered(*columns)
    kind = kind | np.where(new_text, 0, _COVERED).astype(np.int8)
    group = np.cumsum(new_key) - 1
    wide = np.bincount(group, new_text) > wide_texts
    kind |= np.where(wide[group] & new_text, _WIDE, 0).astype(np.int8)
    told = key[new_key][wide]
    by = np.where(kind & _COVERED, mix(doc.view(np.uint64) ^ mix(start.view(np.uint64))), np.where(kind & _WIDE, mix(key ^ mix(content)), key))
    nothing = np.zeros(len(told), np.int64)
    rows = (told, nothing.view(np.uint64), nothing, nothing, nothing.astype(np.int32), np.full(len(told), _TELLS, np.int8))
    return np.concatenate([by, told]), [np.concatenate(c) for c in zip((key, content, doc, start, windows, kind), rows)]


def _dealt(docs: DataFrame, parts: int, length: int, flush_pieces: int, wide_texts: int) -> DataFrame:
    """(part, blob): pieces by a hash of their key, many to a row; covered ones by their place, a wide key's by their text."""

    def flush(held):
        by, columns = _reduced([np.concatenate(c) for c in zip(*held)], wide_texts)
        part = (mix(by) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in columns]
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist()
        ids = [int(part[lo]) for lo in cuts[:-1]]
        blobs = [np.int64(hi - lo).tobytes() + b"".join(c[lo:hi].astype(t).tobytes() for c, (_, t) in zip(columns, _COLUMNS)) for lo, hi in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, base = batch.column("doc_id").to_numpy(), batch.column("base").to_numpy()
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets):
                row, start, windows, key, content, twice = pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                if len(row):
                    held.append((key, content, ids[lo + row], start + base[lo + row], windows, twice.astype(np.int8)))
                    size += len(row)
                if size > flush_pieces:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(giving_back(run), "part long, blob binary")


def _unpacked(blobs) -> list[np.ndarray]:
    out = [[] for _ in _COLUMNS]
    for raw in blobs:
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for column, (_, t) in zip(out, _COLUMNS):
            column.append(np.frombuffer(raw, t, n, at))
            at += column[-1].nbytes
    return [np.concatenate(c) for c in out]


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated pieces of a part: those that an earlier equal piece covers, and the first of each text where texts differ."""
    columns = _unpacked(pdf["blob"])
    covered = columns[5] & _COVERED > 0
    _, _, *gone, _ = (c[covered] for c in columns)
    (key, content, doc, start, windows, kind), new_key, new_text = _ordered(*(c[~covered] for c in columns))
    if not len(key):
        new_key = new_text = np.zeros(0, bool)
    group, tells = np.cumsum(new_key) - 1, kind & _TELLS > 0
    texts, odd = np.bincount(group, new_text), np.bincount(group, kind & (_TWICE | _WIDE | _TELLS) > 0)
    differ = new_text & ((texts[group] > 1) | (odd[group] > 0))
    out = (~new_text | differ) & ~tells
    places = [np.concatenate([c[out], g]).astype(np.int64) for c, g in zip((doc, start, windows), gone)]
    none = np.zeros(len(gone[0]), np.int64)
    return pd.DataFrame({"first": np.concatenate([differ[out], none > 0]), "doc_id": places[0], "start": places[1], "windows": places[2], "key": np.concatenate([key[out].view(np.int64), none])})


# transforms


class Shard:
    """Texts, their suffixes in order (to a depth), and the two symbols before each suffix, the nearer first.

    Symbols are bytes plus one; 0 ends a text.  The suffix at a text's start has 0 before it.
    """

    def __init__(self, texts: list[bytes], depth: int):
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.symbols = raw.astype(np.int16) + 1
        self.symbols[self.ends] = 0
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
        self.order = self._sorted(depth)
        before, further = np.zeros_like(self.symbols), np.zeros_like(self.symbols)
        before[1:] = self.symbols[:-1]
        before[self.starts] = 0
        # the symbol before that: a text's start is preceded by its end
        further[2:] = self.symbols[:-2]
        further[self.starts] = self.symbols[np.maximum(self.ends - 1, self.starts)]
        further[np.minimum(self.starts + 1, self.ends)] = np.where(self.ends > self.starts, 0, further[self.ends])
        self.transform = np.stack([before[self.order], further[self.order]], 1)

    def _sorted(self, depth: int) -> np.ndarray:
        n = len(self.symbols)
        left = (self.ends[self.text] - np.arange(n)).astype(np.int32)  # symbols up to the end of the text
        known = 7
        keys = np.zeros(n, np.uint64)
        for k in range(known):
            keys <<= np.uint64(9)
            keys[: n - k] |= np.where(left[: n - k] >= k, self.symbols[k:], 0).astype(np.uint64)
        order, rank = self._ranked(keys)
        while known < depth:
            step = min(known, depth - known)
            np.left_shift(rank, np.uint64(32), out=keys, dtype=np.uint64)
            keys[: n - step] |= np.where(left[: n - step] >= step, rank[step:] + np.uint32(1), np.uint32(0))
            order, rank = self._ranked(keys)
            known += step
        return order

    @staticmethod
    def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)  # equal keys in any order: their ranks are equal, and the merge counts them alone
        inner = keys[order]
        fresh = np.zeros(len(keys), bool)
        np.not_equal(inner[1:], inner[:-1], out=fresh[1:])
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.cumsum(fresh, dtype=np.uint32)
        return order, rank


def interleave(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merge of sorted shards: for each place the shard, and its common prefix with the place before.

    A round sorts by two symbols at once, so a common prefix below ``depth`` is told in twos
    (the last symbol of an odd one isn't counted); an odd ``depth`` begins with a round of one.
    The i-th place of a shard is the shard's i-th suffix.
    """
    both = np.concatenate(transforms)
    kinds = np.flatnonzero(np.bincount(both[:, 0], minlength=257) + np.bincount(both[:, 1], minlength=257))
    # with at most 256 kinds, numbers of two bytes, which stable sorts go through by radix
    dense = np.zeros(257, np.uint16 if len(kinds) <= 256 else np.uint32)
    dense[kinds] = np.arange(len(kinds))
    near = dense[both[:, 0]]
    pairs = dense[both[:, 1]] * dense.dtype.type(len(kinds)) + near
    n = len(both)
    del both
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    source = np.arange(n)  # place in the shards' transforms, end to end
    block, ordinal = np.zeros(n, np.int32), np.arange(n)
    common, fresh = np.zeros(n, np.int16), np.ones(n, bool)
    for step in [1] * (depth % 2) + [2] * (depth // 2):
        c = (pairs if step == 2 else near)[source]
        move = np.argsort(c, kind="stable")
        shard, moved, c = shard[move], block[move], c[move]
        np.not_equal(c[1:], c[:-1], out=fresh[1:])
        fresh[1:] |= moved[1:] != moved[:-1]
        common += (~fresh).view(np.int8) * np.int8(step)
        block = np.cumsum(fresh, dtype=np.int32)
        if block[-1] == n:
            break
        if len(transforms) == 2:
            second = shard.view(bool)
            source[np.flatnonzero(~second)] = ordinal[: len(transforms[0])]
            source[np.flatnonzero(second)] = ordinal[len(transforms[0]) :]
        else:
            source[np.argsort(shard, kind="stable")] = ordinal
    return shard, common


def repeated_windows(doc: np.ndarray, start: np.ndarray, texts: list[bytes], length: int = LENGTH, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, offset) of the windows of the texts, found at these places, that are equal to an earlier window of them."""
    parts = [np.arange(len(texts))[s::shards] for s in range(min(shards, len(texts)))]
    built = [Shard([texts[i] for i in p], length) for p in parts]
    shard, common = interleave([b.transform for b in built], length)
    n = len(shard)
    docs_, offs, full = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool)
    for s, (b, p) in enumerate(zip(built, parts)):
        at = np.flatnonzero(shard == s)
        t = b.text[b.order]
        docs_[at], offs[at] = doc[p[t]], start[p[t]] + b.order - b.starts[t]
        full[at] = b.ends[t] - b.order >= length
    block = np.cumsum(common < length)
    docs_, offs, block = docs_[full], offs[full], block[full]
    if not len(block):
        return docs_, offs
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    which = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(block))))
    first_doc = np.minimum.reduceat(docs_, heads)[which]
    first_off = np.minimum.reduceat(np.where(docs_ == first_doc, offs, np.iinfo(np.int64).max), heads)[which]
    later = (docs_ != first_doc) | (offs != first_off)
    return docs_[later], offs[later]


def _task(keys: np.ndarray, tasks: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0x5DEECE66D)) % np.uint64(tasks)).astype(np.int64)


def _cutter(length: int, tasks: int):
    """Batches of (doc_id, base, text, asked) -> (task, busy, doc_id, start, piece): the texts of pieces."""

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                rows = []
                for doc_id, base, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "base", "text", "asked"))):
                    raw = text.encode()
                    for w in wanted:
                        at = w["start"] - base
                        rows.append((w["key"], w["busy"], doc_id, w["start"], raw[at : at + w["windows"] + length - 1]))
                if rows:
                    keys, busy, ids, starts, texts = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(_task(np.array(keys, np.int64), tasks)), pa.array(busy), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], ["task", "busy", "doc_id", "start", "piece"])

    return cut


def _windows(length: int, texts: bool):
    """Batches of pieces -> (hash[, doc_id, start, window]) of each window."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                pieces_ = b.column("piece").cast(pa.large_binary())
                data = np.frombuffer(b"".join(pieces_.to_pylist()), np.uint8)
                sizes = pc.binary_length(pieces_).to_numpy()
                n = sizes - length + 1
                which = np.repeat(np.arange(len(n)), n)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum(sizes) - sizes, n) + inner
                hashes = pa.array(span_hashes(prefix_hashes(data), at, at + length).view(np.int64))
                if not texts:
                    yield pa.RecordBatch.from_arrays([hashes], ["hash"])
                    continue
                own = np.lib.stride_tricks.sliding_window_view(data, length)[at]
                windows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(length)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([hashes, b.column("doc_id").take(pa.array(which)), pa.array(b.column("start").to_numpy()[which] + inner), windows], ["hash", "doc_id", "start", "window"])

    return run


def _reducer(tasks: int, held_windows: int, mark_tasks: int = 1):
    """Batches of windows -> (task, doc_id, start, piece): the earliest of equal ones, by their text, and the others as marks, without one.

    Marks have tasks of their own, as many as there are marks for, and those of one stretch of a document the same.
    """

    def run(batches):
        held = {}  # window -> its earliest place so far

        def dealt(rows, first, n):
            keys, ids, starts, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(first + _task(np.array(keys, np.int64), n)), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], ["task", "doc_id", "start", "piece"])

        def let_go():
            items = list(held.items())
            held.clear()
            for lo in range(0, len(items), 20_000):
                yield dealt([(int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True), *place, t) for t, place in items[lo : lo + 20_000]], 0, tasks)

        for b in batches:
            rows = []
            for *place, window in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "window"))):
                place = tuple(place)
                first = held.setdefault(window, place)
                if first != place:
                    # the later one is marked
                    held[window], later = min(first, place), max(first, place)
                    rows.append((later[0] ^ later[1] >> STRETCH_BITS, *later, None))
            if rows:
                yield dealt(rows, tasks, mark_tasks)
            if len(held) >= held_windows:
                yield from let_go()
        if held:
            yield from let_go()

    return run


#: A place is a byte's offset plus its text's number among the texts of its doc_id times this.
_TEXT = 1 << 32


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``docs`` with ``_fl_base``, what the places of its row begin at; (doc_id, base, text) of each document once; and their bytes.

    Nearly always a doc_id has one row, and the base is zero: then ``docs`` isn't shuffled.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    rows = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min("hash") < F.max("hash")).alias("differ"), F.sum(F.octet_length("text")).alias("bytes"))
    size, repeated, differ = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)), F.coalesce(F.bool_or("differ"), F.lit(False))).first()
    based = docs.withColumn("_fl_base", F.lit(0).cast("long"))
    if differ:
        texts = named.join(rows.where("differ").select("doc_id"), "doc_id", "left_semi").select("doc_id", "hash").distinct()
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1
        texts = stored(texts.select(F.col("doc_id").alias("_fl_id"), F.col("hash").alias("_fl_hash"), number.cast("long").alias("_fl_number")), "texts")
        based = docs.join(texts, (F.col("doc_id").cast("long") == F.col("_fl_id")) & (F.xxhash64("text") == F.col("_fl_hash")), "left")
        based = based.select(*docs.columns, (F.coalesce("_fl_number", F.lit(0)) * _TEXT).alias("_fl_base"))
    once = based.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_fl_base").alias("base"), "text")
    return based, once.dropDuplicates(["doc_id", "base"]) if repeated else once, size


def marks(docs: DataFrame, size: int, length: int = LENGTH, task_pieces: int = TASK_PIECES, group_bytes: int = GROUP_BYTES, group_pieces: int = GROUP_PIECES, flush_pieces: int = FLUSH_PIECES, wide_texts: int = WIDE_TEXTS, held_windows: int = HELD_WINDOWS) -> DataFrame:
    """(doc_id, start, windows): runs of windows that are equal to earlier ones, of documents (doc_id, base, text) of ``size`` bytes."""
    parts = max(1, math.ceil(size / ((length - GRAM) / 2) / task_pieces))
    met = _dealt(docs, parts, length, flush_pieces, wide_texts).groupBy("part").applyInPandas(_met, "first boolean, doc_id long, start long, windows long, key long")
    met = stored(met, "met")
    # keys of very many differing texts, fewer than one for each ``group_pieces`` pieces
    busy = stored(met.where("first").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_pieces).select("key", F.lit(True).alias("busy")), "busy")
    first = met.where("first").join(F.broadcast(busy) if busy.count() <= BROADCAST_KEYS else busy, "key", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    total = first.where("not busy").agg(F.coalesce(F.sum(F.col("windows") + length - 1), F.lit(0))).first()[0]
    covered = met.where("not first").select("doc_id", "start", "windows")
    base = F.shiftleft(F.shiftright("start", 32), 32).alias("base")
    asked = first.groupBy("doc_id", base).agg(F.collect_list(F.struct("start", "windows", "key", "busy")).alias("asked"))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, at = pdf["doc_id"].to_numpy(), pdf["start"].to_numpy()
        given = pdf["piece"].notna().to_numpy()
        marked = doc[~given], at[~given]
        if given.any():
            texts = list(pdf["piece"][given])
            marked = [np.concatenate(c) for c in zip(marked, repeated_windows(doc[given], at[given], texts, length))]
            if sum(map(len, texts)) > STEP_BYTES:
                give_back()
        doc, at = marked
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
        return pd.DataFrame({"doc_id": doc[heads], "start": at[heads], "windows": np.diff(np.append(heads, len(doc)))})

    def found(pieces_):
        return covered.unionByName(pieces_.groupBy("task").applyInPandas(merged, "doc_id long, start long, windows long"))

    tasks = max(1, math.ceil(total / group_bytes))
    cuts = docs.join(asked, ["doc_id", "base"]).mapInArrow(giving_back(_cutter(length, tasks)), "task long, busy boolean, doc_id long, start long, piece binary")
    if busy.isEmpty():
        return found(cuts.drop("busy"))
    cuts = stored(cuts, "cuts")
    crowd = cuts.where("busy").select("doc_id", "start", "piece")
    again = stored(crowd.mapInArrow(giving_back(_windows(length, False)), "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    n, most = again.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    windows = crowd.mapInArrow(giving_back(_windows(length, True)), "hash long, doc_id long, start long, window binary")
    windows = windows.join(F.broadcast(again.select("hash")) if n <= BROADCAST_KEYS else again, "hash", "left_semi")
    reducer = _reducer(max(1, math.ceil(4 * n * length / group_bytes)), held_windows, max(1, math.ceil(most / TASK_MARKS)))
    windows = windows.select("doc_id", "start", "window").mapInArrow(giving_back(reducer), "task long, doc_id long, start long, piece binary")
    # no window of a busy key equals one of another, so their tasks follow the others' in one shuffle
    return found(cuts.where("not busy").drop("busy").unionByName(windows.withColumn("task", F.col("task") + tasks)))


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[heads], ends[np.append(heads[1:], len(starts)) - 1]


RESULTS = ["kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(docs: DataFrame, length: int = LENGTH, **sizes) -> DataFrame:
    """``docs`` with kept_text, n_bytes, n_removed, n_spans and kept_sha256."""
    columns = own_columns(docs, RESULTS)
    based, once, size = _numbered(docs.select(*columns))
    start = F.col("start").bitwiseAND(F.lit(_TEXT - 1))
    found = stored(marks(once, size, length, **sizes), "marks").groupBy(F.col("doc_id").alias("_fl_marked_id"), F.shiftleft(F.shiftright("start", 32), 32).alias("_fl_marked_base"))
    found = found.agg(F.collect_list(start).alias("_fl_starts"), F.collect_list(start + F.col("windows") + length - 1).alias("_fl_ends"))
    joined = based.join(found, (F.col("doc_id") == F.col("_fl_marked_id")) & (F.col("_fl_base") == F.col("_fl_marked_base")), "left")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                rows = []
                for text, starts, ends in zip(b.column("text").to_pylist(), b.column("_fl_starts"), b.column("_fl_ends")):
                    raw, gone, n_spans = (text or "").encode(), 0, 0
                    kept = raw
                    if starts.is_valid:
                        a, z = spans(starts.values.to_numpy(), ends.values.to_numpy())
                        cuts, at = [], 0
                        for x, y in zip(a.tolist(), z.tolist()):
                            cuts.append(raw[at:x])
                            at = y
                        kept = b"".join([*cuts, raw[at:]])
                        gone, n_spans = len(raw) - len(kept), len(a)
                    rows.append((kept.decode("utf-8", "ignore") if gone else text, len(raw), gone, n_spans, hashlib.sha256(kept).hexdigest()))
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [*columns, *RESULTS])

    return joined.mapInArrow(giving_back(run), schema_of(docs, columns, "kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE_SQL = {
    # windows are told by a 64-bit hash here
    "op3_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, start, hash(substr(h, 2 * start + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, CAST(greatest(0, length(h) // 2 - 99) AS BIGINT))) AS start FROM d)),
        again AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY x ORDER BY doc_id, start) AS k FROM w) WHERE k > 1),
        -- runs of repeated windows that touch or overlap are one span
        g AS (SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
        spans AS (SELECT doc_id, run, min(start) AS a, max(start) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM g) GROUP BY doc_id, run),
        -- what is kept lies between spans
        k AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b) AS following FROM (SELECT doc_id, 0 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, a, b FROM spans)),
        kept AS (SELECT k.doc_id, string_agg(substr(h, 2 * k.b + 1, 2 * (coalesce(following, length(h) // 2) - k.b)), '' ORDER BY k.b) AS x FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.n, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id) s USING (doc_id)
    """
}
