"""All documents whose sets of n-grams are alike enough, by a size-aware heavy-light join.

Sets are put in one global order, rare n-grams first.  Two sets that link share n-grams among the
first of each, and how those are looked for depends on a set's size:

* light sets enumerate fixed-size subsets: of the first n - o + ``SUBSET`` items of two sets that
  share o, ``SUBSET`` are common, so all subsets of that size are keys, few of which two unlike sets
  share;
* heavy sets, of which that would be too many, stand in the inverted lists of their first
  n - o + 1 items, and a list is scanned for members of a fitting size.  Light sets that a heavy one
  may link with stand in the lists too.

The boundary is the size at which the sum of both costs is least: keys that light sets would write
against entries of lists and the members that a scan of one meets, from a histogram of the sizes
and the counts of the items that are rare.

The order comes from a table of counts of all items by hash, of ``CELLS`` cells whatever the input's
size; any order gives right results, and this one keeps what many documents share out of the keys.
Partial tables are added up by slices, and the sum, 4 bytes a cell, is collected and broadcast.

Links need not be listed to find their classes: equal sets become one representative first, then
every member of a key meets the key's smallest, and of keys that still span several classes all pairs
of different classes are compared.  A short list gives its pairs, each once whatever the number of
keys that have it; long ones are compared in tiles of two blocks of about a thousand members.  A bound
that a folded set gives (a set's parity bits, whose differences can't outnumber the sets') leaves few
pairs for full sets.  A tile gives those as pairs too, at most ``PAIRS_EACH`` for each of its rows;
where more are left, all are compared there and what leaves the tile is one link for each member and
class.  No pair of different classes is left out.

Sets are of 64-bit hashes of n-grams, and equal sets are told by a 128-bit digest.

Null and empty texts and texts without words have no items and are linked with nothing; fewer words
than an n-gram has make one item.  A row comes out for each row: those without a doc_id are linked
with nothing and have a null component_id; rows of one doc_id are of one class, whose links are those
of all its texts, and each has the size of its own set.  A long text is hashed whole by one task, in
arrays of some twenty times its size.  Extra columns of any name are ignored.  An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import mix, steps, stored, utf8
from fieldloom.llm.components import components
from fieldloom.llm.minhash import _TILED, _columns, _confirmed, _grouped, _links_across, _mixed, _of_one_document, shingles

#: Items of a light set's keys.
SUBSET = 2
#: Cells of the table of counts, as a power of two, and the slices in which it is added up.
CELL_BITS, SLICES = 22, 64
#: The largest set that may be light: subsets of larger ones outnumber their lists many times.
LIGHT_LIMIT = 64
#: What it costs to meet a member of a list, in keys written.
SCAN_COST = 0.2
#: Bits of a folded set, at least; sets of more items have more bits than items.
FOLD_BITS = 2048
#: Members of a list whose pairs are listed, and pairs of a tile for each of its rows.
SHORT_LIST, PAIRS_EACH = 8, 8

_FOLD_BYTES = FOLD_BITS // 8

_CELLS = 1 << CELL_BITS
_SHIFT = np.uint64(64 - CELL_BITS)


def least_overlap(n, percent: int):
    """The fewest items that a set of n shares with any set that it links with: those of the smallest such set."""
    return (percent * n + 99) // 100


def _partial_counts(docs: DataFrame, size: int) -> DataFrame:
    """(slice, cells): a task's counts of items by hash, at most 255 each, and as slice -1 its histogram of small sizes."""

    def run(batches):
        counts, sizes = np.zeros(_CELLS, np.int64), np.zeros(LIGHT_LIMIT + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=_CELLS)
                    n = np.array([len(s) for s in sets])
                    sizes += np.bincount(n[n <= LIGHT_LIMIT], minlength=LIGHT_LIMIT + 1)
        cells = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
        full = np.flatnonzero(cells.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([*full.tolist(), -1], pa.int32()), pa.array([*(cells[i].tobytes() for i in full), sizes.tobytes()], pa.binary())], ["slice", "cells"])

    return docs.select("text").mapInArrow(run, "slice int, cells binary")


def _order(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of items by hash over all documents, and the histogram of small sizes."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                part = np.frombuffer(cells.as_py(), np.uint8 if k >= 0 else np.int64)
                sums[k] = sums.get(k, 0) + part.astype(np.int64)
        out = [(k, (np.minimum(v, 1 << 31) .astype(np.uint32) if k >= 0 else v).tobytes()) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["slice", "cells"])

    counts, sizes = np.zeros((SLICES, _CELLS // SLICES), np.uint32), np.zeros(LIGHT_LIMIT + 1, np.int64)
    for k, cells in _partial_counts(docs, size).repartition("slice").mapInArrow(add, "slice int, cells binary").collect():
        if k >= 0:
            counts[k] = np.frombuffer(cells, np.uint32)
        else:
            sizes = np.frombuffer(cells, np.int64)
    return counts.ravel(), sizes


def light_sizes(counts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[int, int]:
    """The smallest and the largest size of light sets; none are light where the second is below the first.

    A light set of n writes a key for each subset; a heavy one writes an entry for each of its
    first items and meets the others of their lists, about as many as the rarest items of which
    lists are made have on average.
    """
    n = np.arange(len(sizes))
    over = n - least_overlap(n, percent)
    subsets = np.ones(len(n))
    for k in range(SUBSET):
        subsets = subsets * (over + SUBSET - k) / (k + 1)
    ordered = np.sort(counts[counts > 0]).astype(np.float64)
    rare = np.searchsorted(np.cumsum(ordered), ordered.sum() * (100 - percent) / 100)
    met = (ordered[: rare + 1] ** 2).sum() / max(1.0, ordered[: rare + 1].sum())
    first = int(np.argmax(least_overlap(n, percent) >= SUBSET))
    gain = np.where((over > 0) | (100 * n // percent > n), sizes * ((over + 1) * (1 + SCAN_COST * met) - subsets), 0.0)
    gain[:first] = 0
    total = np.cumsum(gain)
    best = int(np.argmax(total))
    return first, best if total[best] > 0 else first - 1


def _keys(s: np.ndarray, counts: np.ndarray, percent: int, first: int, last: int) -> np.ndarray:
    """The keys of a set: its lists, its subsets or both.  Sets of a size that links with equal ones alone have none."""
    n = len(s)
    over = n - least_overlap(n, percent)
    if not over and 100 * n // percent == n:
        return np.zeros(0, np.uint64)
    ordered = s[np.lexsort((s, counts[(s >> _SHIFT).astype(np.int64)]))[: over + SUBSET]]
    lists = ordered[: over + 1]
    if not first <= n <= last:
        return lists
    i, j = np.triu_indices(len(ordered), 1)
    a, b = np.minimum(ordered[i], ordered[j]), np.maximum(ordered[i], ordered[j])
    subsets = mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    mixed = 100 * n // percent > last or least_overlap(n, percent) < first
    return np.concatenate([subsets, lists]) if mixed else subsets


def _folded(s: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of items has it."""
    bits = max(FOLD_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _at_size(sig: bytes, size: int) -> np.ndarray:
    """A folded set folded further."""
    return np.bitwise_xor.reduce(np.frombuffer(sig, np.uint8).reshape(-1, size), axis=0)


def _sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    counts, sizes = _order(docs, size)
    first, last = light_sizes(counts, sizes, percent)
    order = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "n_shingles", "s1", "s2", "sig", "bands"]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                sig, keys, marks = [None] * (hi - lo), [None] * (hi - lo), np.zeros((hi - lo, 2), np.int64)
                for i, s in enumerate(sets):
                    if len(s):
                        sig[i], keys[i] = _folded(s), _keys(s, order.value, percent, first, last).view(np.int64)
                        marks[i] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>")


def _may_link(differing, na, nb, percent: int):
    """Whether sets of these sizes that differ in so many items at least may link."""
    return ((100 + percent) * differing <= (100 - percent) * (na + nb)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _differing(x: bytes, y: bytes) -> int:
    """Items in which two folded sets differ at least, by as many bits as both have."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(_at_size(x, size) ^ _at_size(y, size)).sum(dtype=np.int64))


def _pairs_that_fit(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_differing) of the pairs whose folded sets don't rule a link out."""
    both = pairs
    for x in "ab":
        both = both.join(sigs.select(F.col("id").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}")), x)

    def run(batches):
        for t in batches:
            differing = np.array([_differing(x, y) for x, y in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist())], np.int64)
            keep = pa.array(np.flatnonzero(_may_link(differing, t.column("na").to_numpy(), t.column("nb").to_numpy(), percent)))
            yield pa.RecordBatch.from_arrays([t.column("a").take(keep), t.column("b").take(keep), pa.array(differing).take(keep)], ["a", "b", "n_differing"])

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long, n_differing long")


def _short_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): the pairs of different classes of lists (key, id, label) of bounded length, each once."""
    members = lists.groupBy("key").agg(F.collect_list(F.struct("id", "label")).alias("c"))
    others = lambda x: F.transform(F.filter("c", lambda y: (y["id"] > x["id"]) & (y["label"] != x["label"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
    return members.select(F.explode(F.flatten(F.transform("c", others))).alias("p")).select("p.a", "p.b").distinct()


def _tiles_that_fit(mixed: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs of tiles' rows of different classes that folded sets don't rule out (id, partner); of tiles with many of them their rows, without a partner."""

    def compare(part):
        ids, labels, _, asks, asked = _columns(part)
        full, n = part.column("sig").to_pylist(), part.column("n").to_numpy()
        sig = np.array([_at_size(x, _FOLD_BYTES) for x in full])
        found, pairs = np.zeros(len(ids), bool), []
        for i in np.flatnonzero(asks).tolist():
            there = np.flatnonzero(asked & (labels != labels[i]))
            near = there[_may_link(np.bitwise_count(sig[there] ^ sig[i]).sum(1, dtype=np.int64), n[there], n[i], percent)]
            if len(full[i]) > _FOLD_BYTES:
                near = near[[bool(_may_link(_differing(full[i], full[j]), n[i], n[j], percent)) for j in near.tolist()]] if len(near) else near
            found[near] = True
            found[i] |= len(near) > 0
            if len(pairs) <= PAIRS_EACH * len(ids):
                pairs += [(i, j) for j in near.tolist()]
        if not pairs:
            return None
        rows = part.select(_TILED)
        if len(pairs) > PAIRS_EACH * len(ids):
            rows = rows.filter(pa.array(found))
            return rows.append_column("partner", pa.nulls(rows.num_rows, pa.int64())).combine_chunks().to_batches()[0]
        i, j = (pa.array([p[k] for p in pairs]) for k in (0, 1))
        return rows.take(i).append_column("partner", part.column("id").take(j)).combine_chunks().to_batches()[0]

    return _grouped(mixed.join(sigs, "id"), compare, "key long, block long, id long, label long, minor boolean, asks boolean, asked boolean, partner long")


def ngram_jaccard_classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id reachable by links of at least ``percent`` (50 to 100)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(_sketches(docs, shingle_words, percent), "sketches")
    docs = docs.where("doc_id is not null")
    named = sketches.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    reps = named.join(classes.select("s1", "s2", F.col("id").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    reps = stored(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "bands"), "representatives")
    sigs = reps.select("id", "n", "sig")
    rows = reps.select("id", "n", F.explode("bands").alias("key"))
    lists = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "first")
    bands = stored(rows.join(lists, "key"), "lists")
    fits = 100 * F.least("n", "first.n") >= percent * F.greatest("n", "first.n")
    stars = bands.where(F.col("id") != F.col("first.id")).where(fits).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
    best = _pairs_that_fit(stars, sigs, percent).groupBy("b").agg(F.min_by("a", F.struct("n_differing", "a")).alias("a"))
    links = _confirmed(best, docs, shingle_words, percent).union(_of_one_document(named, classes))
    labels = components(links.where("linked"))
    labelled = stored(bands.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "labelled")
    spans = stored(labelled.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key", "members"), "spans")
    pairs = _pairs_that_fit(_short_pairs(labelled.join(spans.where(F.col("members") <= SHORT_LIST), "key", "left_semi")), sigs, percent).select("a", "b")
    long = labelled.join(spans.where(F.col("members") > SHORT_LIST), "key", "left_semi").select("key", "id")
    tiles = stored(_tiles_that_fit(_mixed(long, labels), sigs, percent), "tiles")
    pairs = pairs.union(tiles.where("partner is not null").select(F.least("id", "partner"), F.greatest("id", "partner")))
    links = links.union(_confirmed(pairs, docs, shingle_words, percent)).union(_links_across(tiles.where("partner is null").drop("partner"), docs, shingle_words, percent))
    labels = components(links.where("linked"))
    own = sketches.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("label", "id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, percent=85)


QUERIES = {"op12_ngram_jaccard": op12_ngram_jaccard}
ORACLE_SQL = {
    "op12_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS x FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        f AS (SELECT x, count(*) AS f FROM s GROUP BY x),
        -- of two sets that are alike enough, the rarest shingles share one
        p AS (SELECT doc_id, x, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k FROM s JOIN f USING (x) JOIN n USING (doc_id)),
        q AS (SELECT doc_id, x, n FROM p WHERE k <= n - (n * 85 + 99) // 100 + 1),
        c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
        e AS (SELECT a, b FROM c JOIN s u ON u.doc_id = a JOIN s v ON v.doc_id = b AND v.x = u.x GROUP BY a, b, na, nb HAVING 100 * count(*) >= 85 * (na + nb - count(*))),
        r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, g.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) g ON g.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """
}
