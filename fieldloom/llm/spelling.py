"""Groups of spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

An edit (one code point inserted, deleted or replaced) takes at most one letter away and adds at
most one, so the letter counts of two words that are near differ by at most two in all.  Words stand
in k-d trees over their counts, a tree for each length up to ``LONGEST`` and one for all beyond.
A word looks for those near it in the trees of its length and of the lengths beside it: a box of
counts is left out where more than one letter would have to be added to the word to enter it, or more
than one taken away.  Words that a search finds are then compared letter by letter.

The upper levels of the trees are laid in Spark, a level of all trees in one aggregation: a node of
more than ``LEAF`` words is cut at the count of the letter that halves it best.  Beyond ``MAX_LEAVES``
leaves the leaves are larger instead, so the tree that is broadcast has a bound: some 200 bytes a
leaf.  Words go to their own leaf and, as askers, to those whose box they may reach; a task goes
through the lower levels of one leaf with all its askers at once.  Words that no letter tells apart
(which are never near each other at one length) are cut by a hash.  What leaves a leaf is a row for
each asker, never a pair.

Forms are followed by doubling pointers: n at least doubles with each form, so a word is a few
rounds from its root.

Nulls and empty texts have no words; a null doc_id counts as an empty string where runs are mangled.
Repeated rows count as often as they stand.  Ties between forms go to the word that is smaller by
code points.  A long text is read whole by one task, in arrays of some thirty times its size; counts
of letters are clipped at 127, which can only find words too many, and those are compared.  Extra
columns of any name are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import prefix_hashes, span_hashes, steps, stored, utf8

#: Occurrences and code points of a word that counts.
LEAST_N, LEAST_LENGTH = 3, 5
#: Times that a form's n is at least its word's.
FORM_TIMES = 2
#: One run in so many, by hash, loses a letter.
MANGLED = 97
#: Words of a leaf of the trees that Spark lays, and how many leaves there are at most.
LEAF, MAX_LEAVES = 16384, 1 << 14
#: Words of a leaf of the lower levels, within a task.
LOW_LEAF = 256
#: Words of this length or more stand in one tree.
LONGEST = 64
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Letters: a-z and U+00C0 to U+00FF.
LETTERS = 26 + 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BY_BYTE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def _zeros_after(crc: np.ndarray) -> np.ndarray:
    """What is left of checksums once another byte follows them, without that byte's own part."""
    return (crc >> np.uint32(8)) ^ _BY_BYTE[crc & np.uint32(255)]


def _mangled(word: bytes, h: int) -> bytes:
    s = word.decode()
    k = h % len(s)
    return (s[:k] + s[k + 1 :]).encode()


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of lower-cased UTF-8 stand in letters, and which of them begin one of U+00C0 to U+00FF."""
    lead = data == 0xC3
    letter = ((data >= 97) & (data <= 122)) | lead
    letter[1:] |= lead[:-1]
    return letter, lead


def _count_step(data: np.ndarray, offsets: np.ndarray, ids: list, total: dict[bytes, int]) -> None:
    low = _LOWER[data]
    letter, lead = runs(low)
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (np.append(True, ~letter[:-1]) | edge[:n]))
    ends = np.flatnonzero(letter & (np.append(~letter[1:], True) | edge[1:])) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (leads[ends] - leads[starts])
    long_enough = points >= LEAST_LENGTH
    starts, ends, points = starts[long_enough], ends[long_enough], points[long_enough]
    if not len(starts):
        return
    _, at, which = np.unique(span_hashes(prefix_hashes(low), starts, ends), return_index=True, return_inverse=True)
    raw = low.tobytes()
    found = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    own = np.array([zlib.crc32(w) for w in found], np.uint32)[which]
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    crc = np.array([zlib.crc32(h) for h in heads], np.uint32)
    row, length = np.searchsorted(offsets, starts, "right") - 1, ends - starts
    order = np.argsort(length, kind="stable")
    h, done = np.zeros(len(starts), np.uint32), 0
    cuts = np.searchsorted(length[order], np.arange(LONGEST + 2))
    for k in range(1, LONGEST + 1):
        crc = _zeros_after(crc)
        part = order[cuts[k] : cuts[k + 1]]
        h[part] = crc[row[part]] ^ own[part]
        done = cuts[k + 1]
    for i in order[done:].tolist():
        h[i] = zlib.crc32(heads[row[i]] + found[which[i]])
    hit = h % np.uint32(MANGLED) == 0
    for w, c in zip(found, np.bincount(which[~hit], minlength=len(found)).tolist()):
        if c:
            total[w] = total.get(w, 0) + c
    for i in np.flatnonzero(hit & (points > LEAST_LENGTH)).tolist():
        w = _mangled(found[which[i]], int(h[i]))
        total[w] = total.get(w, 0) + 1


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of enough letters and occurrences."""

    def run(batches):
        total: dict[bytes, int] = {}

        def rows():
            words = list(total)
            for lo in range(0, len(words), 1 << 16):
                part = words[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([total[w] for w in part], pa.int64())], ["word", "n"])

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in steps(offsets):
                _count_step(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids[lo:hi], total)
                if len(total) > HELD_WORDS:
                    yield from rows()
                    total.clear()
        yield from rows()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


class Words:
    """A batch of words: bytes, code points as letters 0 to 89, and clipped counts of letters."""

    def __init__(self, column):
        data, self.offsets = utf8(column)
        lead = data == 0xC3
        after = np.append(False, lead[:-1])
        codes = np.where(after, data.astype(np.int64) - 0x80 + 26, data.astype(np.int64) - 97)[~lead]
        leads = np.concatenate([[0], np.cumsum(lead)])
        ends = self.offsets - leads[self.offsets]
        self.length = np.diff(ends)
        self.codes, self.heads = codes.astype(np.uint8), ends[:-1]
        self.counts = np.zeros((len(self.length), LETTERS), np.int8)
        rows = np.repeat(np.arange(len(self.length)), self.length)
        full, times = np.unique(rows * LETTERS + codes, return_counts=True)
        self.counts.ravel()[full] = np.minimum(times, 127)

    def letters(self, i: np.ndarray, width: int) -> np.ndarray:
        """Their letters, padded to a width."""
        at = self.heads[i][:, None] + np.arange(width)
        inside = np.arange(width) < self.length[i][:, None]
        return np.where(inside, self.codes[np.minimum(at, max(0, len(self.codes) - 1))], 255) if len(self.codes) else np.full((len(i), width), 255)


    def sets(self) -> np.ndarray:
        """64 bits of the letters that a word has, and of those that it has twice; an edit changes two at most."""
        k = np.arange(LETTERS, dtype=np.uint64)
        once, twice = np.where(k < 26, k, 26 + k % 12), 38 + k % 26
        bits = lambda has, at: np.bitwise_or.reduce(np.where(has, np.uint64(1) << at.astype(np.uint64), np.uint64(0)), axis=1)
        return bits(self.counts > 0, once) | bits(self.counts > 1, twice)

    def halves(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and of the last ``n`` letters of each word, of which none is shorter."""
        powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
        hashed = lambda at: ((self.codes[at[:, None] + np.arange(n)].astype(np.uint64) + np.uint64(1)) * powers).sum(1, dtype=np.uint64)
        return hashed(self.heads), hashed(self.heads + self.length - n)


#: A cut: (letter, highest count of the left side, left child, right child); letter -1 cuts by a bit of the word's hash.
Cut = tuple[int, int, int, int]


def _leaf_of(words: Words, hashes: np.ndarray, cuts: dict[int, Cut]) -> np.ndarray:
    """The leaf of each word; roots are the lengths."""
    out = np.minimum(words.length, LONGEST)
    todo = [(int(r), np.flatnonzero(out == r)) for r in np.unique(out)]
    while todo:
        node, rows = todo.pop()
        out[rows] = node
        if node in cuts and len(rows):
            letter, most, left, right = cuts[node]
            is_left = words.counts[rows, letter] <= most if letter >= 0 else (hashes[rows] >> most) & 1 == 0
            todo += [(left, rows[is_left]), (right, rows[~is_left])]
    return out


def _hashes(column) -> np.ndarray:
    return np.array([zlib.crc32((w or "").encode()) for w in column.to_pylist()], np.int64)


def _grown(words: DataFrame) -> dict[int, Cut]:
    """The cuts of all trees, laid level by level: a job for each level, a row for each node that is cut."""
    size = F.least(F.char_length("word"), F.lit(LONGEST))
    counts = {r["root"]: r["n"] for r in words.groupBy(size.alias("root")).agg(F.count(F.lit(1)).alias("n")).collect()}
    capacity = max(LEAF, 2 * sum(counts.values()) // MAX_LEAVES)
    cuts: dict[int, Cut] = {}
    growing, following, level = {r: n for r, n in counts.items() if n > capacity}, LONGEST + 1, 0
    while growing:
        nodes = set(growing)

        def histogram(batches, nodes=nodes, cuts=dict(cuts)):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                own = Words(batch.column("word"))
                leaf = _leaf_of(own, _hashes(batch.column("word")), cuts)
                for node in nodes & set(np.unique(leaf).tolist()):
                    c = own.counts[leaf == node].astype(np.int64) + np.arange(LETTERS) * 128
                    totals[node] = totals.get(node, 0) + np.bincount(c.ravel(), minlength=LETTERS * 128)
            for node, t in totals.items():
                full = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), node)), pa.array(full // 128), pa.array(full % 128), pa.array(t[full])], ["node", "letter", "most", "n"])

        sums = words.select("word").mapInArrow(histogram, "node long, letter long, most long, n long").groupBy("node", "letter", "most").agg(F.sum("n").alias("n"))
        letter = Window.partitionBy("node", "letter")
        sums = sums.select("node", "letter", "most", F.sum("n").over(letter.orderBy("most")).alias("left"), F.sum("n").over(letter).alias("all")).where("left < all")
        best = {r["node"]: r["best"] for r in sums.groupBy("node").agg(F.min(F.struct(F.abs(2 * F.col("left") - F.col("all")).alias("off"), "letter", "most", "left", "all")).alias("best")).collect()}
        below = {}
        for node in sorted(growing):
            b = best.get(node)
            cuts[node] = (b["letter"], b["most"], following, following + 1) if b else (-1, level, following, following + 1)
            left = b["left"] if b else growing[node] // 2
            below |= {following: left, following + 1: growing[node] - left}
            following += 2
        growing, level = {k: n for k, n in below.items() if n > capacity and level < 31}, level + 1
    return cuts


def _boxes(words: DataFrame, cuts: dict[int, Cut]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The least and the largest counts of letters of every leaf's words, and of the nodes above."""

    def partial(batches):
        found: dict[int, list] = {}
        for batch in batches:
            own = Words(batch.column("word"))
            leaf = _leaf_of(own, _hashes(batch.column("word")), cuts)
            for k in np.unique(leaf).tolist():
                c = own.counts[leaf == k]
                lo, hi = found.get(k, (c[0], c[0]))
                found[k] = np.minimum(lo, c.min(0)), np.maximum(hi, c.max(0))
        yield from _box_rows(found)

    def merged(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            for k, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("leaf", "lo", "hi"))):
                lo, hi = np.frombuffer(lo, np.int8), np.frombuffer(hi, np.int8)
                old = found.get(k, (lo, hi))
                found[k] = np.minimum(lo, old[0]), np.maximum(hi, old[1])
        yield from _box_rows(found)

    schema = "leaf long, lo binary, hi binary"
    rows = words.select("word").mapInArrow(partial, schema).repartition("leaf").mapInArrow(merged, schema).collect()
    boxes = {r["leaf"]: (np.frombuffer(r["lo"], np.int8), np.frombuffer(r["hi"], np.int8)) for r in rows}
    for node in sorted(cuts, reverse=True):
        sides = [boxes[k] for k in cuts[node][2:] if k in boxes]
        if sides:
            boxes[node] = np.minimum.reduce([s[0] for s in sides]), np.maximum.reduce([s[1] for s in sides])
    return boxes


def _box_rows(found: dict):
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v[0].astype(np.int8).tobytes() for v in found.values()], pa.binary()), pa.array([v[1].astype(np.int8).tobytes() for v in found.values()], pa.binary())], ["leaf", "lo", "hi"])


def reaches(counts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a word (a row of counts) is at most one added and one removed letter from the box."""
    added = np.maximum(lo - counts, 0).sum(1, dtype=np.int64)
    removed = np.maximum(counts - hi, 0).sum(1, dtype=np.int64)
    return (added <= 1) & (removed <= 1)


def _dealt(words: DataFrame, cuts: dict[int, Cut], boxes: dict) -> DataFrame:
    """(leaf, asks, word, n): each word in its own leaf, and as an asker in each leaf that it may reach."""
    tree = words.sparkSession.sparkContext.broadcast((cuts, boxes))

    def run(batches):
        cuts, boxes = tree.value
        for batch in batches:
            own = Words(batch.column("word"))
            leaves, rows = [_leaf_of(own, _hashes(batch.column("word")), cuts)], [np.arange(batch.num_rows)]
            for length in np.unique(own.length).tolist():
                same = np.flatnonzero(own.length == length)
                todo = [(r, same) for r in {min(length + d, LONGEST) for d in (-1, 0, 1)} if r in boxes]
                while todo:
                    node, part = todo.pop()
                    part = part[reaches(own.counts[part], *boxes[node])]
                    if len(part) and node in cuts:
                        todo += [(k, part) for k in cuts[node][2:] if k in boxes]
                    elif len(part):
                        leaves.append(np.full(len(part), node))
                        rows.append(part)
            asks = np.repeat([False, True], [len(rows[0]), sum(map(len, rows[1:]))])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves)), pa.array(asks), batch.column("word").take(at), batch.column("n").take(at)], ["leaf", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "leaf long, asks boolean, word string, n long")


def one_edit(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether rows of padded letters are exactly one insertion, deletion or replacement apart."""
    out = (la == lb) & ((a != b).sum(1) == 1)
    for x, y, where in ((a, b, la == lb + 1), (b, a, lb == la + 1)):
        i = np.flatnonzero(where)
        long, short = x[i], y[i]
        differ = long != short
        first = np.where(differ.any(1), differ.argmax(1), long.shape[1])
        after = np.arange(long.shape[1] - 1) >= first[:, None]
        out[i] = ~((long[:, 1:] != short[:, :-1]) & after).any(1)
    return out


def _searched(members: Words, askers: Words):
    """(asker, member) arrays of the words that are near, tile by tile: all askers go down the lower levels at once."""
    used = np.flatnonzero(members.counts.any(0))
    # letters that no member has can only be taken away, so one column holds them all
    narrow = lambda w: np.hstack([w.counts[:, used], np.minimum(w.counts.sum(1, dtype=np.int64) - w.counts[:, used].sum(1, dtype=np.int64), 127).astype(np.int8)[:, None]])
    m, q = narrow(members), narrow(askers)
    m_set, q_set = members.sets(), askers.sets()
    # an edit stands in one half of a word at most: of two that are near, the first or the last so many letters are the same
    half = (int(members.length.min()) - 1) // 2
    (m_first, m_last), (q_first, q_last) = members.halves(half), askers.halves(half)
    todo = [(np.arange(len(m)), np.arange(len(q)))]
    while todo:
        own, asking = todo.pop()
        c = m[own]
        asking = asking[reaches(q[asking], c.min(0), c.max(0))]
        if not len(asking):
            continue
        spread = c.max(0) > c.min(0)
        if len(own) > LOW_LEAF and spread.any():
            middle = np.median(c[:, spread], axis=0).astype(np.int8)
            off = np.minimum(np.abs(2 * (c[:, spread] <= middle).sum(0) - len(own)), np.abs(2 * (c[:, spread] < middle).sum(0) - len(own)))
            k = int(off.argmin())
            column = c[:, np.flatnonzero(spread)[k]]
            left = column <= middle[k]
            if abs(2 * int((column < middle[k]).sum()) - len(own)) < abs(2 * int(left.sum()) - len(own)):
                left = column < middle[k]
            if left.any() and not left.all():
                todo += [(own[left], asking), (own[~left], asking)]
                continue
        for at in range(0, len(own), LOW_LEAF):
            some = own[at : at + LOW_LEAF]
            for lo in range(0, len(asking), 8192):
                part = asking[lo : lo + 8192]
                alike = (m_first[some][None] == q_first[part][:, None]) | (m_last[some][None] == q_last[part][:, None])
                i, j = np.nonzero(alike & (np.bitwise_count(m_set[some][None] ^ q_set[part][:, None]) <= 2))
                i, j = part[i], some[j]
                by = m[j] - q[i]
                keep = (np.maximum(by, 0).sum(1, dtype=np.int64) <= 1) & (np.minimum(by, 0).sum(1, dtype=np.int64) >= -1)
                i, j = i[keep], j[keep]
                keep = np.abs(askers.length[i] - members.length[j]) <= 1
                i, j = i[keep], j[keep]
                step = max(1, (1 << 23) // int(max(members.length.max(), askers.length.max()) + 1))
                for a in range(0, len(i), step):
                    x, y = i[a : a + step], j[a : a + step]
                    width = int(max(askers.length[x].max(), members.length[y].max())) + 1
                    ok = one_edit(askers.letters(x, width), members.letters(y, width), askers.length[x], members.length[y])
                    yield x[ok], y[ok]


def _near_of_leaf(table: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best): for each asker of one leaf, what it finds there."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    order = pc.sort_indices(table, [("word", "ascending")]).to_numpy()
    sides = [table.take(pa.array(order[asks[order] == s])).select(["word", "n"]).combine_chunks() for s in (False, True)]
    members, askers = (Words(t.column("word")) for t in sides)
    empty = np.zeros(0, np.int64)
    found = list(_searched(members, askers)) if len(members.length) and len(askers.length) else []
    i, j = (np.concatenate([f[k] for f in found] or [empty]) for k in (0, 1))
    n = sides[0].column("n").to_numpy()
    by = np.lexsort((j, -n[j], i))
    i, j = i[by], j[by]
    who, first, times = np.unique(i, return_index=True, return_counts=True)
    best = pa.array(j[first])
    return pa.table({"word": sides[1].column("word").take(pa.array(who)), "n_near": pa.array(times.astype(np.int64)), "best_n": sides[0].column("n").take(best), "best": sides[0].column("word").take(best)})


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers are doubled until none moves."""
    out = stored(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        up = out.select(F.col("word").alias("root"), F.col("root").alias("up"))
        out = stored(out.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "pointers")
        if out.where("moved").isEmpty():
            return out.select("word", "root")
        out = out.select("word", "root")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stored(counted_words(docs), "words")
    cuts = _grown(words)
    dealt = _dealt(words, cuts, _boxes(words, cuts))
    near = dealt.groupBy("leaf").applyInArrow(_near_of_leaf, "word string, n_near long, best_n long, best string")
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    rows = rows.union(near.select("word", F.lit(None).cast("long"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best"))).alias("best")
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("best.n") >= FORM_TIMES * F.col("n")
    forms = stored(found.select("word", F.when(is_form, F.col("best.best")).alias("form"), "n", "n_near", F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    out = forms.join(_roots(forms.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: DuckDB has no CRC-32 to mangle runs with; the query is held against a plain version.
ORACLE_SQL: dict[str, str] = {}
