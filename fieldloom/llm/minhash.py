"""Near-duplicate detection by min-max hashing.

Each permutation of a document's shingles gives two signature values, its minimum and its
maximum, so half the hash evaluations give a signature of a length.  Bands of values make the
buckets; candidates are confirmed on full shingle sets.

Links need not be listed to find their groups, and the pairs of a large bucket are never
emitted.  Equal sets become one representative first.  Then, round by round:

1. every member of a bucket is compared with the bucket's smallest member;
2. in buckets that still span several groups, every member outside the bucket's largest group
   is compared by signatures, in tiles of two blocks of about ``BLOCK`` members, with the members
   of other groups, and its likeliest partner of each tile is confirmed;
3. in buckets that span several groups even then, all pairs across groups that signatures
   don't rule out are compared on full sets, tile by tile; what leaves a tile is one link
   for each member and group that it links, so no link between groups is lost for a cap.

A tile is the most that a task holds, however large the bucket.  Members that link to nothing
are all compared with each other, so m of them in a bucket make about m * m / BLOCK rows.

Signatures rule a pair out only far below the threshold (``SLACK``).  A pair at the threshold
shares no bucket with probability (1 - 0.8^5)^40, about 1e-7.

Sets are of 64-bit hashes of shingles, and equal sets are told by a 128-bit digest: two different
shingles are taken for one with probability 2^-64.

Null and empty texts and texts without words have no shingles and are alone.  Fewer words than
a shingle has make one shingle.  A row comes out for each row with a doc_id; rows without are left
out.  Rows of one doc_id are of one group, whose links are those of all its texts; each has the
size of its own set.  Of a group the smallest doc_id stays.  A long text is hashed whole by one
task, in arrays of some twenty times its size.  Extra columns of any name are ignored.  An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import giving_back, mix, prefix_hashes, span_hashes, steps, stored, utf8, words
from fieldloom.llm.components import components

PERCENT = 80
BANDS, ROWS = 40, 5
#: Permutations: each gives two values.
PERMUTATIONS = BANDS * ROWS // 2
#: Signature similarity, in values of the signature, below which a pair isn't confirmed: the
#: expectation at the threshold less about six standard deviations.
SLACK = 34
#: Members of a block, about: blocks are dealt by hash, and a task compares two of them at a time.
BLOCK = 1000
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = _LOWER[data]
    starts, ends, first = words(low, offsets)
    w = span_hashes(prefix_hashes(low), starts, ends)
    n = len(w)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([w[k:], np.zeros(min(k, n), np.uint64)]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(h[a : b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            whole = np.uint64(0)
            for x in w[a:b]:
                whole = mix(np.array([whole * np.uint64(31) + x if whole else x]))[0]
            out.append(mix(np.array([whole + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima and maxima under each permutation: a row of 2 * PERMUTATIONS for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    heads = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * PERMUTATIONS, len(sets)), np.uint32)
    v = np.empty_like(x)
    for i in range(PERMUTATIONS):
        np.multiply(x, _A[i], out=v)
        np.add(v, _B[i], out=v)
        np.minimum.reduceat(v, heads, out=out[i])
        np.maximum.reduceat(v, heads, out=out[PERMUTATIONS + i])
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit bucket keys for each signature; a band has values of different permutations."""
    # maxima are taken in another order, so a permutation's two values fall into bands that share no other
    order = np.arange(2 * PERMUTATIONS).reshape(ROWS, BANDS).T
    h = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, order[:, k]].astype(np.uint64))
    return mix(h + np.arange(BANDS, dtype=np.uint64))


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                sig, bands, marks = [None] * (hi - lo), [None] * (hi - lo), np.zeros((hi - lo, 2), np.int64)
                if len(full):
                    values = signatures([sets[i] for i in full])
                    keys, small = band_keys(values).view(np.int64), mix(values.astype(np.uint64)).astype(np.uint8)
                    for j, i in enumerate(full.tolist()):
                        sig[i], bands[i] = small[j].tobytes(), keys[j]
                        marks[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(giving_back(run), schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, items): the sorted shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in steps(offsets):
                sets = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "items"])

    return docs.mapInArrow(giving_back(run), "id long, items binary")


def _same(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum())


def _likely(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(a, b, same) of the pairs whose signatures agree in ``least`` values."""
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for b in batches:
            same = np.array([_same(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())], np.int64)
            keep = np.flatnonzero(same >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep)), pa.array(same[keep])], ["a", "b", "same"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, same long")


def _wanted_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, items) of the documents of ``ids``."""
    ids = stored(ids, "ids")
    wanted = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    return stored(_sets(wanted, size).dropDuplicates(["id", "items"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) of each pair, on full sets; only documents of pairs are read again for their sets."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    sets = _wanted_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), size)
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("ia"), batch.column("ib")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return stored(both.select("a", "b", "ia", "ib").mapInArrow(giving_back(run), "a long, b long, linked boolean"), "confirmed")


def _grouped(rows: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` (a table of one bucket's tile -> a record batch or None) over the rows of each (key, block), streamed in order."""
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches):
        left = None

        def done(table):
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1, [len(key)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 1 and (out := compare(table.slice(lo, hi - lo))) is not None:
                    yield out

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([left, table]) if left is not None else table
            # all but the last bucket's tile is complete
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from done(table.slice(0, cut).combine_chunks())
            left = table.slice(cut)
        if left is not None:
            yield from done(left.combine_chunks())

    return dealt.mapInArrow(giving_back(run), schema)


_TILED = ["key", "block", "id", "label", "minor", "asks", "asked"]


def _columns(part: pa.Table):
    return (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "minor", "asks", "asked"))


def _mixed(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, block, id, label, minor, asks, asked) of the members of buckets that span several groups.

    Members of a bucket's largest group and the others, which are minor, are dealt to blocks
    each.  ``block`` is a tile: a block of minor members, which ask, and one of the largest
    group or another one of minor members, who are asked.  In its tile with the largest group's
    first block, a minor block is asked too, so every pair across groups that has a minor member
    meets in one tile, and a tile has two blocks at most.
    """
    rows = bands.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    groups = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("members")).where("groups > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    rows = rows.join(mixed, "key").select("key", "id", "label", (F.col("label") != F.col("top")).alias("minor"), blocks(F.col("most")).alias("tops"), blocks(F.col("members") - F.col("most")).alias("minors"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("tops"))))
    # a tile is the asking block's number times the count of all blocks, and the asked block's number, the largest group's first
    tile = lambda asking, asked: asking * (F.col("tops") + F.col("minors")) + asked
    item = lambda block, asks, asked: F.struct(block.alias("block"), asks.alias("asks"), asked.alias("asked"))
    home, yes, no = F.col("home"), F.lit(True), F.lit(False)
    to_tops = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tops") - 1), lambda j: item(tile(home, j), yes, j == 0))
    later = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1), lambda j: j > home), lambda j: item(tile(home, F.col("tops") + j), yes, no))
    earlier = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1), lambda j: j < home), lambda j: item(tile(j, F.col("tops") + home), no, yes))
    of_top = F.transform(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1), lambda i: item(tile(i, home), no, yes))
    rows = rows.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(to_tops, later, earlier)).otherwise(of_top)))
    return rows.select("key", "at.block", "id", "label", "minor", "at.asks", "at.asked")


def _likeliest(mixed: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(a, b): for each minor member of a tile the likeliest member of another group."""

    def compare(part):
        ids, labels, minor, asks, asked = _columns(part)
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        others = np.flatnonzero(asked)
        most, best = np.zeros(len(ids), np.int64), np.full(len(ids), np.iinfo(np.int64).max)
        for i in np.flatnonzero(asks).tolist():
            there = others[labels[others] != labels[i]]
            same = (sig[there] == sig[i]).sum(1)
            near = same >= least
            there, same = there[near], same[near]
            if not len(there):
                continue
            first = ids[there[same == same.max()]].min()
            if (same.max(), -first) > (most[i], -best[i]):
                most[i], best[i] = same.max(), first
            better = (same > most[there]) | ((same == most[there]) & (ids[i] < best[there]))
            most[there[better]], best[there[better]] = same[better], ids[i]
        out = [sorted((ids[i], best[i])) for i in np.flatnonzero(minor & (most > 0)).tolist()]
        if out:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["a", "b"])

    return _grouped(mixed.join(sigs, "id"), compare, "a long, b long").distinct()


def _possible(mixed: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The rows of ``mixed`` that signatures don't rule out: those with a likely partner in another group of their tile."""

    def compare(part):
        ids, labels, _, asks, asked = _columns(part)
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        found = np.zeros(len(ids), bool)
        for i in np.flatnonzero(asks).tolist():
            there = np.flatnonzero(asked & (labels != labels[i]))
            near = there[(sig[there] == sig[i]).sum(1) >= least]
            found[near] = True
            found[i] |= len(near) > 0
        if found.any():
            return part.filter(pa.array(found)).select(_TILED).to_batches()[0]

    return _grouped(mixed.join(sigs, "id"), compare, "key long, block long, id long, label long, minor boolean, asks boolean, asked boolean")


def _links_across(possible: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked): for each asking member and each other group of its tile, its most similar member if that is a link.

    Every pair of a tile that spans two groups is compared here on full sets; the rows that
    leave the task are links alone.
    """
    possible = stored(possible, "possible")
    sets = _wanted_sets(docs, possible.select(F.col("id").alias("doc_id")).distinct(), size)

    def compare(part):
        ids, labels, _, asks, asked = _columns(part)
        items = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("items")]
        n = np.array([len(x) for x in items])
        heads = np.concatenate([[0], np.cumsum(n)])
        _, dense = np.unique(np.concatenate(items), return_inverse=True)
        out = set()
        for i in np.flatnonzero(asks).tolist():
            mark = np.zeros(int(dense.max()) + 1, np.int64)
            mark[dense[heads[i] : heads[i + 1]]] = 1
            common = np.add.reduceat(mark[dense], heads[:-1])
            union = n + n[i] - common
            there = np.flatnonzero(asked & (labels != labels[i]) & (100 * common >= percent * union))
            for label in np.unique(labels[there]):
                own = there[labels[there] == label]
                out.add(tuple(sorted((int(ids[i]), int(ids[own[np.argmax(common[own] / union[own])]])))))
        if out:
            a, b = zip(*sorted(out))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([True] * len(a))], ["a", "b", "linked"])

    return stored(_grouped(possible.join(sets, "id"), compare, "a long, b long, linked boolean"), "across")


def _of_one_document(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, linked): the classes of doc_ids whose rows have different sets, linked through the doc_id."""
    several = sketches.groupBy("doc_id").agg((F.min(F.struct("s1", "s2")) < F.max(F.struct("s1", "s2"))).alias("several")).where("several").select("doc_id")
    own = sketches.where("n_shingles > 0").select("doc_id", "s1", "s2").join(several, "doc_id", "left_semi").distinct()
    return own.join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("linked"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(_sketches(docs, shingle_words), "sketches")
    least = 2 * PERMUTATIONS * percent // 100 - SLACK
    classes = sketches.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    reps = stored(sketches.where("n_shingles > 0").join(classes.select("s1", "s2", F.col("id").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("id"), "sig", "bands"), "representatives")
    sigs = reps.select("id", "sig")
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    bands = stored(rows.join(buckets, "key"), "bands")
    stars = bands.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    likely = _likely(stars, sigs, least)
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    links = _confirmed(best, docs, shingle_words, percent).union(_of_one_document(sketches, classes))
    mixed = _mixed(bands, components(links.where("linked")))
    links = links.union(_confirmed(_likeliest(mixed, sigs, least), docs, shingle_words, percent))
    mixed = stored(_mixed(bands, components(links.where("linked"))), "mixed")
    links = links.union(_links_across(_possible(mixed, sigs, least), docs, shingle_words, percent))
    labels = components(links.where("linked"))
    own = sketches.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    own = own.join(labels, "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
ORACLE_SQL = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        f AS (SELECT x, count(*) AS f FROM s GROUP BY x),
        -- of two sets that are alike enough, the rarest shingles share one
        p AS (SELECT doc_id, x, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k FROM s JOIN f USING (x) JOIN n USING (doc_id)),
        q AS (SELECT doc_id, x, n FROM p WHERE k <= n - (n * 80 + 99) // 100 + 1),
        c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        e AS (SELECT a, b FROM c JOIN s u ON u.doc_id = a JOIN s v ON v.doc_id = b AND v.x = u.x GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
        r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, g.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) g ON g.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """
}
