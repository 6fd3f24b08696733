"""Every operator against a plain version, on the smallest tables and on edge cases."""

import base64
import collections
import hashlib
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from fieldloom.llm import bpe, common, components, exact, html, langid, lines, minhash, mph, packing, quality, suffix, warc
from fieldloom.llm.boost import BoostedTrees

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n", "\n\n", "a", "a\n\na\n a \nb", "   x\x1c\x1dy\x85z  \r\n\t", "日本語テキスト" * 5, "!" * 5000, " " * 4000, "it's we'LL 123४५", "a b c a b c", "x" * 3000, "‍﻿😀😀", "tie tie tie tie"]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n double, fp string, key string, kept int"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", f"src{i % 2}", len(t or ""), 1.0, "x", "k", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df, [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


# helpers


def test_perfect_hash():
    keys = common.mix(np.arange(30_000, dtype=np.uint64))
    p = mph.PerfectHash.from_bytes(mph.PerfectHash.build(keys).to_bytes())
    assert sorted(p.index(keys).tolist()) == list(range(len(keys)))
    assert len(mph.PerfectHash.build(np.zeros(0, np.uint64)).index(keys)) == len(keys)


def test_words_and_steps():
    data, offsets = common.utf8(pa.array(ODD))
    starts, ends, first = common.words(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(ODD):
        got = [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == brute.WORD.findall(t or "")
    assert [x for lo, hi in common.steps(offsets, 10) for x in range(lo, hi)] == list(range(len(ODD)))
    assert common.utf8(pa.array(["xx", None, "abc"]).slice(1))[0].tobytes() == b"abc"


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 5)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {80: 80, 90: 80, 100: 80}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_numbered_chains(spark):
    """Long chains numbered in order, at random, and with the smallest id at the end of a rise; versions linked with the next four."""
    n, rng = 3000, np.random.default_rng(11)
    parts = [np.arange(n), rng.permutation(n), np.append(np.arange(1, n), 0), rng.permutation(n)]
    edges = [(10_000 * k + int(p[i]), 10_000 * k + int(p[i + d])) for k, p in enumerate(parts) for d in ((1, 2, 3, 4) if k == 3 else (1,)) for i in range(n - d)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["id"], r["label"]) for r in got} == {(10_000 * k + i, 10_000 * k) for k in range(4) for i in range(n)} and len(got) == 4 * n
    loop = components.components(spark.createDataFrame([(5, 5), (7, 6), (6, 7)], "a long, b long")).collect()
    assert {r["id"]: r["label"] for r in loop} == {5: 5, 6: 6, 7: 6}


# 1


def test_bpe_equals_library(spark, table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t, _ in table[1]] + ODD
    codec = bpe.BytePairCodec.load(PATH, P.PATTERN)
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t or "")
        assert codec.decode(ids) == (t or "").encode()


def test_bpe_of_long_texts(monkeypatch):
    """A text is encoded alike whether its pre-tokens are held at once or not."""
    codec, texts = bpe.BytePairCodec.load(PATH, P.PATTERN), [None, "some words, 123 and\n  more " * 30, "é" * 99, ""]
    whole = codec.encode(texts)
    monkeypatch.setattr(bpe, "LONG_CHARS", 40)
    assert codec.encode(texts) == whole


def test_bpe_columns(spark):
    df = docs_of(spark, ODD)
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).select("doc_id", "decoded", "key").collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    trip = {r["doc_id"]: r for r in bpe.round_trip(df, PATH, P.PATTERN).collect()}
    assert all(trip[i]["decoded_sha256"] == brute.sha((t or "").encode()) for i, t in enumerate(ODD))
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0


# 2


def _near(df, size):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, table, size):
    assert _near(table[0], size) == brute.near([(i, t) for i, t, _ in table[1]], size)


def test_near_duplicates_spread_group(spark):
    """A group whose members are linked through each other, not all to the first; and edge cases."""
    rng = np.random.default_rng(3)
    base, texts = [f"w{i}" for i in range(120)], list(ODD)
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 14))):
            words[at] = f"x{rng.integers(0, 4)}"
        texts.append(" ".join(words).upper() if i % 3 else " ".join(words))
    old, minhash.BLOCK = minhash.BLOCK, 20
    try:
        assert _near(docs_of(spark, texts), 2) == brute.near(list(enumerate(texts)), 2)
    finally:
        minhash.BLOCK = old
    assert minhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_tiles_of_a_bucket_of_unlinked_members(spark):
    """No task holds more than two blocks of a bucket, and every pair across groups meets in one tile."""
    n, block = 600, 50
    bands = spark.range(n).select(F.lit(7).cast("long").alias("key"), "id")
    labels = spark.range(n).where("id < 150 or id >= 590").select("id", F.when(F.col("id") < 150, F.lit(0)).otherwise(F.lit(590)).cast("long").alias("label"))
    old, minhash.BLOCK = minhash.BLOCK, block
    try:
        rows = minhash._mixed(bands, labels).collect()
    finally:
        minhash.BLOCK = old
    tiles, met = collections.defaultdict(list), collections.Counter()
    for r in rows:
        tiles[r["key"], r["block"]].append(r)
    assert max(map(len, tiles.values())) < 3 * block
    for t in tiles.values():
        met.update({tuple(sorted((x["id"], y["id"]))) for x in t if x["asks"] for y in t if y["asked"] and x["label"] != y["label"]})
    label = {r["id"]: r["label"] for r in rows}
    assert met == {(a, b): 1 for a in range(n) for b in range(a + 1, n) if label[a] != label[b]}


# 3


def _passages(df, **sizes):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, **sizes).collect()}


def test_passages(spark, table):
    expected = {i: (*x[:3], brute.sha(x[3])) for i, x in brute.passages([(i, t) for i, t, _ in table[1]]).items()}
    assert _passages(table[0], task_pieces=3000, group_bytes=50_000) == expected
    assert _passages(table[0], group_pieces=3) == expected


def test_passages_of_odd_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abé "), 7))
    shared = "".join(word() for _ in range(40))
    texts = ODD + ["ab" * 400, "ba" * 300, shared, "q" + shared[50:220] + "z", shared[3:150] + shared[3:150], "x" * 99, "x" * 100, shared]
    got = {i: (*x[:3], brute.sha(x[3])) for i, x in brute.passages(list(enumerate(texts))).items()}
    assert _passages(docs_of(spark, texts)) == got
    assert suffix.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


@pytest.fixture(scope="session")
def spread_passage():
    """A passage in differing contexts, a text that many documents hold whole, and what is left of them."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, whole = word(180), word(300)
    texts = [whole if i % 3 == 0 else word(60) + passage + word(60) for i in range(240)] + [passage, whole[:120]]
    return texts, {i: (*x[:3], brute.sha(x[3])) for i, x in brute.passages(list(enumerate(texts))).items()}


def test_passages_of_busy_keys_are_reduced_and_dealt(spark, spread_passage):
    texts, expected = spread_passage
    df = docs_of(spark, texts)
    for sizes in ({"flush_pieces": 300, "wide_texts": 4}, {"flush_pieces": 1, "wide_texts": 1}, {"flush_pieces": 300, "wide_texts": 4, "task_pieces": 50, "group_pieces": 10}):
        assert _passages(df, **sizes) == expected
    # the texts that many hold and the texts of one key don't meet in one part
    dealt = suffix._dealt(df.coalesce(1).withColumn("base", F.lit(0).cast("long")), 64, suffix.LENGTH, 1 << 20, 4).groupBy("part").agg(F.collect_list("blob").alias("blob")).collect()
    held = [suffix._unpacked(r["blob"]) for r in dealt]
    apart = [np.bincount(np.unique(k[x & suffix._COVERED == 0], return_inverse=True)[1]).max(initial=0) for k, *_, x in held]
    assert max(apart) < 20 and sum(len(k) for k, *_ in held) > 1000


def test_windows_of_busy_keys_are_reduced(spark, spread_passage):
    texts, expected = spread_passage
    for held in (1 << 20, 100):
        assert _passages(docs_of(spark, texts), group_pieces=3, held_windows=held) == expected
    # a task deals one copy of a window that all its documents hold, in any order of theirs, and marks the others
    ids, text = [5, 3, 9, 1], texts[1].encode()[2:131]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([2] * len(ids)), pa.array([text] * len(ids), pa.binary())], ["doc_id", "start", "piece"])
    (windows,) = suffix._windows(100, True)([batch])
    assert [(r["doc_id"], r["start"], r["window"]) for r in windows.to_pylist()] == [(d, 2 + i, text[i : i + 100]) for d in ids for i in range(30)]
    (hashes,) = suffix._windows(100, False)([batch])
    assert hashes.column("hash").equals(windows.column("hash")) and len(set(hashes.column("hash").to_pylist())) == 30
    rows = [r for b in suffix._reducer(7, 1 << 20)([windows]) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["start"]) for r in rows if r["piece"]) == [(1, i) for i in range(2, 32)]
    assert sorted((r["doc_id"], r["start"]) for r in rows if not r["piece"]) == [(d, i) for d in (3, 5, 9) for i in range(2, 32)]


def test_marks_of_few_busy_windows_are_spread():
    # a passage of thirty windows that very many documents hold: few texts, many marks
    n, text = 3000, np.random.default_rng(4).integers(97, 123, 129, np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([7] * n), pa.array([text] * n, pa.binary())], ["doc_id", "start", "piece"])
    rows = [r for b in suffix._reducer(1, 1 << 20, 16)(suffix._windows(100, True)([batch])) for r in b.to_pylist()]
    assert sum(r["piece"] is not None for r in rows) == 30 and len(rows) == 30 * n
    tasks = collections.Counter(r["task"] for r in rows)
    assert tasks[0] == 30 and len(tasks) == 17 and max(tasks.values()) < len(rows) / 8
    # one task makes runs of a document's marks
    assert len({(r["doc_id"], r["task"]) for r in rows if r["piece"] is None}) == n - 1


def test_interleave_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 40, 30)]
    built = [suffix.Shard(texts[s::3], 6) for s in range(3)]
    shard, common_ = suffix.interleave([b.transform for b in built], 6)
    taken, merged = [0, 0, 0], []
    for s in shard:
        b = built[s]
        at = b.order[taken[s]]
        taken[s] += 1
        merged.append(bytes((b.symbols[at : min(at + 6, b.ends[b.text[at]])] - 1).astype(np.uint8)))
    assert merged == sorted(merged)
    for x, y, c in zip(merged, merged[1:], common_[1:]):
        k = next((i for i in range(6) if x[i : i + 1] != y[i : i + 1] or i >= len(x)), 6)
        assert c // 2 == k // 2 or x == y and len(x) < 6


# 4


def test_counting_quotient_filters_merge():
    rng = np.random.default_rng(2)
    many = rng.integers(0, 1 << 60, 5000, dtype=np.uint64)
    parts = [rng.choice(many, 3000) for _ in range(4)]
    filters = [exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.build(*np.unique(p, return_counts=True), 4, 0).to_bytes()) for p in parts]
    merged = exact.CountingQuotientFilter.merge(filters)
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.fingerprints() == keys).all() and (merged.counts == counts).all()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_exact_groups(spark, limit):
    texts = ODD + ["a  b", "a b", "a\tb", None, "tie tie tie tie"]
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    expected = {i: (ids[0], len(ids), i == ids[0], brute.sha(n.encode())) for n, ids in groups.items() for i in ids}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_groups(docs_of(spark, texts), limit).collect()}
    assert got == expected
    assert exact.exact_groups(docs_of(spark, texts).limit(0)).count() == 0


# 5


def test_tokens_equal_library(table):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokenizer.load(path)
    odd = ["İstanbul ΣΑΣ. ΣΑΣ, ÉCOLE, <|endoftext|> a<|endoftext|>b, <|ENDOFTEXT|>", "é . , .., a., a.b", "naïve NAÏVE. Naïve,", "e\u0301tude \u0301x ß ẞ ÿ Ÿ ª µ", "x\u00a0y\u3000z a\x85b", "\t  lead and trail \n", "don't we'LL 12,5 word,. ,word Word,"]
    texts = [t for _, t, _ in table[1]] + ODD + odd
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.by_word and _ids_of(own, texts) == expected
    own.by_word = False  # as under other rules
    try:
        assert _ids_of(own, texts) == expected
    finally:
        own.by_word = True


def _ids_of(tokenizer, texts):
    found, offsets = tokenizer.encode(pa.array(texts, pa.string()))
    return [found[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_other_rules_are_told_by_the_file(tmp_path):
    """A file that doesn't lower-case isn't tokenised by words."""
    import json

    rules = json.load(open(P.path("word_bpe_49k.json")))
    rules["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(rules))
    own = packing.WordTokenizer.load(str(tmp_path / "cased.json"))
    assert not own.by_word and _ids_of(own, ["A b"]) == [own.tokenizer.encode("A b", add_special_tokens=False).ids]


def test_long_texts_are_tokenised_in_parts(spark):
    """A text over the size of a group, and groups of several texts."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdé,. "), 6)) for _ in range(n)) for n in (3, 30_000, 5, 0, 900)] + [None, "y" * 40_000, ""]
    path = P.path("word_bpe_49k.json")
    own = packing.WordTokenizer.load(path)
    ids = _ids_of(own, texts)
    assert sum(map(len, ids)) > 60_000
    for r in packing.pieces(docs_of(spark, texts).coalesce(1), path, ids=True, group_bytes=20_000).collect():
        assert r["ids"] == (ids[r["doc_id"]] + [2])[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) + 1
    parts, row = packing._chunks(pa.array(texts), 1000)
    assert row.tolist() == sorted(row.tolist()) and len(parts) > 100
    whole = [sum((x for x, i in zip(_ids_of(own, parts.to_pylist()), row) if i == k), []) for k in range(len(texts))]
    assert whole == ids


def test_histogram_packing():
    rng = np.random.default_rng(4)
    for size in (8, 64, 4096):
        h = {int(x): int(rng.integers(0, 60)) for x in rng.integers(1, size + 1, 150)}
        got = collections.Counter()
        for n, pattern in packing.pack_histogram(h, size):
            assert n > 0 and 0 < sum(pattern) <= size
            for x in pattern:
                got[x] += n
        assert got == collections.Counter({k: v for k, v in h.items() if v})


@pytest.mark.parametrize("rank_rows", [100_000, 3])
def test_packed_sequences(spark, table, rank_rows):
    df = table[0].select("doc_id", "text").union(docs_of(spark, ODD, 10_000).select("doc_id", "text"))
    path = P.path("word_bpe_49k.json")
    parts = common.stored(packing.pieces(df, path, size=512, ids=True))
    rows = packing.pack(parts, size=512, rank_rows=rank_rows).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    own = packing.WordTokenizer.load(path)
    for doc_id, text in df.collect():
        parts = sorted(by_doc[doc_id], key=lambda r: r["start"])
        ids = _ids_of(own, [text])[0] + [2]
        assert [i for r in parts for i in r["ids"]] == ids and parts[0]["doc_tokens"] == len(ids)
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
    for s in by_sequence.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s])[:-1].tolist() and s[-1]["offset"] + s[-1]["length"] <= 512
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= total / 512 * 1.02 + 1


def _plain_packs(lengths, size):
    """How many packs there are when each piece, longest first, goes to the shortest pack that has room."""
    packs = []
    for x in sorted(lengths, reverse=True):
        i = int(np.argmin(packs)) if packs else None
        if packs and packs[i] + x <= size:
            packs[i] += x
        else:
            packs.append(x)
    return len(packs)


def test_registered_packing_against_a_plain_packer(spark, sf_dir, table):
    """The registered query, at its own size, against packing the pieces one by one."""
    rows = packing.op5_packing(spark, sf_dir).collect()
    own = packing.WordTokenizer.load(P.path("word_bpe_49k.json"))
    ids = {i: x + [2] for (i, _, _), x in zip(table[1], _ids_of(own, [t for _, t, _ in table[1]]))}
    by_sequence, covered = collections.defaultdict(list), collections.Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: len(x) for i, x in ids.items()}
    for s in by_sequence.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(s[-1]) <= 4096
    assert len(by_sequence) <= _plain_packs([r["length"] for r in rows], 4096) * 1.02 + 1


def test_packing_nothing(spark):
    parts = common.stored(packing.pieces(docs_of(spark, ODD).limit(0), P.path("word_bpe_49k.json")))
    assert packing.pack(parts).count() == 0


# 6


@pytest.mark.parametrize("sizes", [{}, {"shard_lines": 10, "task_lines": 5}])
def test_lines(spark, table, sizes):
    texts = ODD + ["  A shared line of twenty \nown", "a shared LINE of twenty\t\na shared line of twenty", "x\nA SHARED LINE OF TWENTY", "twenty characters ok\n" * 3, "TWENTY characters ok", "twenty characters ok\n"]
    df = docs_of(spark, texts, 10_000).select("doc_id", "text", "fp").union(table[0].select("doc_id", "text", F.lit("x")))
    rows = [(i + 10_000, t) for i, t in enumerate(texts)] + [(i, t) for i, t, _ in table[1]]
    expected = {i: (a, b, brute.sha(t.encode())) for i, (a, b, t) in brute.lines(rows).items()}
    got = lines.drop_repeated_lines(df, **sizes)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()} == expected
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_shard_keeps_lines_of_equal_first_hash(spark):
    rows = [(1, 7, 70), (2, 7, 70), (3, 7, 70), (1, 7, 71), (2, 7, 71), (4, 7, 71), (1, 8, 80)]
    raw = lines.line_shards(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"), 3, 1).collect()[0]["arrays"]
    d, a, b = (np.array(x, np.int64) for x in zip((1, 7, 70), (3, 7, 70), (1, 7, 71), (4, 7, 71), (1, 8, 80), (1, 7, 72)))
    assert lines.ShardArrays(bytes(raw)).drops(d, a, b).tolist() == [True, False, True, False, False, False]


# 7


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    assert ((BoostedTrees.fit(x[:1500], y[:1500]).margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


@pytest.fixture(scope="session")
def model():
    return html.fit(None)


def test_main_text_of_layouts(model):
    """Held-out accuracy on generated layouts, and a page of each kind of trouble."""
    right = total = 0
    for source in html.generated_pages(120, seed=1234):
        page = html.Page(source, marked=True)
        y, keep = html._labels(page), html.decode(page, model.margin([page]))
        right += sum(keep[i] == (y[i] > 0) for i in page.texts)
        total += len(page.texts)
    assert right / total > 0.96
    body = " ".join(["Plain words of a story, told at length."] * 6)
    page = f"<html><head><title>t</title><script>x='<p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=cookie-notice>We use cookies.</div><article><h1>A &amp; B</h1><p>{body}<p><b>Open\n\t<i>bold</i><br>next. {body}</article><footer>&copy; us</footer>"
    assert html.extract([page, None, "", "no markup", "<"], model)[:3] == [f"A & B {body} Open bold next. {body}", "", ""]


def _story(n, r):
    words = "when rivers rose over old stone walls people carried bread wool and lamps uphill until morning came quietly again".split()
    return " ".join(" ".join(r.choice(words) for _ in range(r.integers(6, 15))).capitalize() + "." for _ in range(n))


def test_main_text_of_pages_written_by_hand(model):
    """No semantic elements, and names that no page of the training has: density, links and place must tell."""
    r = np.random.default_rng(21)
    a, b, c, d = (_story(n, r) for n in (5, 4, 6, 3))
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Start", "World", "Sport", "Money", "Weather", "Archive"))
    pages = [
        (f"<html><body><div class=zq1><ul>{menu}</ul></div><div class=zq2><div class=zq3><h1>High water</h1><p>{a}</p><p>{b}</p><p>{c}</p></div></div><div class=zq4><a href=/1>Imprint</a> <a href=/2>Rules</a> <a href=/3>Jobs</a></div></body></html>", ["High water", a, b, c]),
        (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a><br><a href=4>Four</a></td><td><h2>A year</h2><p>{b}<p>{c} <i>And</i> more.<blockquote>{a}</blockquote></td></tr></table>", ["A year", b, c + " And more.", a]),
        (f"<div id=qqx><div>{''.join(f'<div><a href={i}>{x}</a></div>' for i, x in enumerate('abcdefgh'))}</div></div><div id=qqy><p>{a}</p><p>{d}</p><ul><li>{b}</li><li>{c}</li></ul></div>", [a, d, b, c]),
        (f"<div class=vvk><p>{a}</p><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> and <object data=x>fallback text</object> <svg><text>drawn</text></svg> <canvas>plain</canvas> here. {b}</p><p>{c}</p></div>", [a, f"Energy is E=m and fallback text drawn plain here. {b}", c]),
        (f"<p>{a}</p><script>if (1 < 2) document.write('<p>no</p>')</script><p>{b}</p><style>p {{}}</style><template><p>no</p></template><p>{c}</p>", [a, b, c]),
    ]
    for source, expected in pages:
        assert html.extract([source], model) == [" ".join(expected)]


def test_decoding_is_the_best_labelling(model):
    """Against all labellings of small trees, and with margins at random; nothing is kept below a dropped node."""
    rng = np.random.default_rng(8)
    sources = ["<div><p>a b c</p><div>d<p>ef</p></div></div><p>g</p>", "<ul><li>a<li>bb</ul><div><div><p>ccc</p></div></div>", "a<div>b</div>c"] + html.generated_pages(20, seed=5)
    for source in sources:
        page = html.Page(source)
        n = len(page.tags)
        for _ in range(4):
            margin = rng.normal(size=n)
            keep = html.decode(page, margin)
            assert keep[0] and all(keep[page.parent[i]] for i in range(1, n) if keep[i])
            if n <= 12:
                value = margin * [np.log2(2.0 + len(page.texts[i])) if i in page.texts else 1.0 for i in range(n)]
                legal = ([True, *(bool(m >> i & 1) for i in range(n - 1))] for m in range(1 << n - 1))
                best = max(sum(v for v, k in zip(value[1:], x[1:]) if k) for x in legal if all(x[page.parent[i]] for i in range(1, n) if x[i]))
                assert abs(sum(value[1:][keep[1:]]) - best) < 1e-9


def test_tokens_are_learned_from_pages():
    """A token of many pages gets log odds from their labels; one of few pages none."""
    pages = [html.Page(f"<div class='good rare{i}'><p data-label=main>text {i}</p></div><div class=bad><p>other</p></div>", marked=True) for i in range(5)]
    odds = html.token_odds(pages, [html._labels(p) for p in pages])
    good, bad, rare = (odds[html._buckets(x)[0]] for x in ("good", "bad", "rare"))
    assert good > 0.3 and bad < -0.3 and odds[html._buckets("neverseen")[0]] == 0
    assert html.token_odds(pages[:2], [html._labels(p) for p in pages[:2]]).any() == False  # noqa: E712


def test_main_text_of_pages(spark, sf_dir, model):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html.main_text(pages, html.fit(pages)).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)
        parts = re.split(r"<(?:p|/p|h1|/h1|br)[^>]*>", re.sub(r"<[^>]*$", "", m[1]) if m else "")
        parts = [re.sub(r"[\x20\x09-\x0d]+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip(" ") for x in parts]
        expected = " ".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == expected and got[r["page_id"]]["n_chars"] == len(expected)


# 8

PAGES = [(0, "http://a/ b", "same"), (1, None, "same"), (2, "http://c", None), (3, "", ""), (4, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 3), (5, "u", "same"), (None, "n", "alone")]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    raw = warc.arc_version_block(version, "x.arc", "19990102030405")
    bodies = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://x 1 2 3 4\n", b"", b"text only"]
    for b in bodies:
        raw += warc.arc_record(version, {"URL": "http://x/a b", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html"}, b)
    head, *records = warc.parse_arc(raw)
    assert head.version == version and [r.block for r in records] == bodies and {r.fields["URL"] for r in records} == {"http://x/a b"}
    made = [warc.to_warc(r) for r in records]
    assert [m.headers["WARC-Type"] for m in made] == ["response", "resource", "resource"]
    assert made[0].headers["WARC-Date"] == "1999-01-02T03:04:05Z" and made[0].headers["WARC-Payload-Digest"] == f"sha1:{warc.digest(b'body' + bodies[0][bodies[0].index(b'body') + 4:])}"
    assert warc.to_warc(head).headers["WARC-Type"] == "warcinfo"
    again = list(warc.parse_warc(b"".join(m.to_bytes() for m in made)))
    assert [r.block for r in again] == bodies
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw[:-5]))


def test_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    for minimum, revisits in ((0, {0: 5, 1: 5, 2: 3}), (1, {0: 5, 1: 5})):
        for version in (1, 2, None):
            got = warc.read_archives(common.stored(warc.convert(common.stored(warc.write_arc(df, version=version)), minimum))).collect()
            ids = {r["record_id"]: r["page_id"] for r in got if r["record_type"] == "response"}
            assert {r["page_id"]: ids[r["refers_to_id"]] for r in got if r["record_type"] == "revisit"} == revisits
            assert len(got) == len(PAGES)
            for r in got:
                payload = (dict((p, h) for p, _, h in PAGES)[r["page_id"]] or "").encode()
                assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
                assert r["target_uri"] == (dict((p, u) for p, u, _ in PAGES)[r["page_id"]] or "-").replace(" ", "%20") and r["date"] == "2024-01-01T00:00:00Z"


def test_archives_of_many_revisits(spark, monkeypatch):
    """Beyond the bound of a broadcast the same rows come out of a shuffle."""
    df = spark.createDataFrame([(i, f"u{i}", f"page {i % 7}") for i in range(60)], "page_id long, url string, html string")
    broadcast = sorted(map(str, warc.revisits(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_IDS", 0)
    assert sorted(map(str, warc.revisits(df).collect())) == broadcast and sum("revisit" in r for r in broadcast) == 53


def test_arc_files(spark, tmp_path):
    """Files of both versions, plain and compressed, with records of other kinds, through the converter and back."""
    import gzip

    html = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page</p>"
    expected = {}
    for version in (1, 2):
        for packed in (False, True):
            out, date = [warc.arc_version_block(version, "crawl.arc", "19970101000000")], f"1998010203040{version}"
            for k, block in enumerate((html, b"plain text\n", b"", b"\n\nhttp://looks.like/a 0.0.0.0 19990101000000 text/plain 3\nabc")):
                url = f"http://site{version}{packed}/{k} with space"
                out.append(warc.arc_record(version, {"URL": url, "IP-address": "10.0.0.1", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200"}, block))
                payload = warc.split_http(block)[2]
                expected[url] = ("response" if k == 0 else "resource", f"1998-01-02T03:04:0{version}Z", len(payload), warc.digest(payload))
            (tmp_path / f"a{version}{packed}.arc{'.gz' * packed}").write_bytes(b"".join(map(gzip.compress, out)) if packed else b"".join(out))
    records = warc.read_archives(common.stored(warc.convert(warc.read_files(spark, f"file://{tmp_path}")))).collect()
    assert {r["target_uri"]: (r["record_type"], r["date"], r["payload_bytes"], r["payload_digest"]) for r in records} == expected and len(records) == len(expected)
    assert len({r["record_id"] for r in records}) == len(expected)


# 9


def test_quality(spark, table):
    rows = table[1] + [(10_000 + i, t, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limits in ({}, {"line_docs": 1, "left_percent": 60}):
        got = {r["doc_id"]: r for r in quality.cleaned(df, **limits).collect()}
        assert len(got) == len(rows)
        for (i, t, _), (failed, kept, gone, text) in zip(rows, brute.quality(rows, **limits)):
            assert {k: got[i][k] for k in quality.COUNTS} == brute.measures(t)
            assert (got[i]["base_failed"], got[i]["kept"], got[i]["n_shared_words"], got[i]["text"] or "") == (failed, kept, gone, text)
    assert quality.quality_rules(df.limit(0)).count() == 0 and quality.cleaned(df.limit(0)).count() == 0


def test_quality_of_repeated_and_unnamed_rows(spark):
    """Rows of one doc_id count once and are judged by their own text; rows without one by the base rules."""
    line, words = "a line of seven words for all", " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line}\n{words} {i}", "h") for i in range(4)] + [(3, f"{line}\n{words} 3", "h"), (3, "other", "h"), (3, f"{line}\n{words} 3", None), (None, f"{line}\n{words}", "h"), (None, "few", None), (2, f"{line}\n" * 2, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit(77), "n_words": F.lit("x"), "row": F.lit(1)})
    for line_docs in (3, 4):
        expected = sorted((str(r[0]), r[1], *x) for r, x in zip(rows, brute.quality(rows, line_docs)))
        got = quality.cleaned(df, line_docs=line_docs).withColumn("was", F.lit(0)).collect()
        assert sorted((str(r["doc_id"]), r["base_failed"], r["kept"], r["n_shared_words"], r["text"]) for r in got) == sorted((x[0], *x[2:]) for x in expected)
        plain = quality.quality_rules(df, line_docs=line_docs).collect()
        assert sorted((str(r["doc_id"]), r["kept"], r["n_shared_words"]) for r in plain) == sorted((x[0], x[3], x[4]) for x in expected)


# 10


def test_code_lengths_equal_a_plain_coder(spark, table):
    """Exact bits under each language, from trees that one task each has made, for learned, foreign and odd texts."""
    learned = {"x": ["the cat sat on the mat", "", "a dog\nand a cat"], "y": ["der Hund und die Katze über all", "ü"], "z": [t for _, t, _ in table[1][:3]]}
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, v in learned.items() for t in v)], "doc_id long, text string, lang string")
    m = langid.train(df)
    texts = ["the hat", "Katze", "x", "", "日本", "ü" * 9, *(t for _, t, _ in table[1][2:6])]
    data, offsets = common.utf8(pa.array(texts))
    assert m.langs == ["x", "y", "z"]
    got = m.code_lengths(data, offsets)
    assert np.allclose(got, [[brute.code_length([t for t in learned[lang] if t], x) for lang in m.langs] for x in texts], rtol=1e-12, atol=1e-9)
    again = langid.ContextTree.from_bytes(m.trees[1].to_bytes())
    grams = np.unique(langid._grams(data, offsets))
    assert (again.bits(grams) == m.trees[1].bits(grams)).all()


def test_code_lengths_are_probabilities():
    """In every context that occurs, the probabilities of all 256 bytes sum to one at most."""
    data, offsets = common.utf8(pa.array(["the cat sat on the mat", "der Hund"]))
    grams, n = np.unique(langid._grams(data, offsets), return_counts=True)
    tree = langid.ContextTree.train(grams, n.astype(float))
    for context in np.unique(grams >> np.uint32(8)):
        assert 0.5 < np.exp2(-tree.bits((context << np.uint32(8)) + np.arange(256, dtype=np.uint32))).sum() <= 1 + 1e-12


def test_samples_bound_what_is_learned(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("en").alias("lang"))
    n = [len(langid.train(df, **x).trees[0].strings[3]) for x in ({}, {"docs_per_language": 40}, {"bytes_per_language": 2000})]
    assert n[0] > 5 * n[1] > 0 and n[0] > 5 * n[2] > 0


def test_language(spark, table):
    df = table[0]
    assert langid.predict(df, None).where("lang_pred <> 'und' or score <> 0").isEmpty()
    model = langid.train(df.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.predict(df.union(spark.createDataFrame([(90_000 + i, t, None, None, 0) for i, t in enumerate(ODD)], df.schema)), model).collect()}
    known = {r["doc_id"]: r["lang"] for r in df.where(langid.held_out(F.col("doc_id"))).collect()}
    assert sum(got[i]["lang_pred"] == x for i, x in known.items()) / len(known) > 0.95
    assert [got[90_000 + i]["lang_pred"] == "und" for i in range(5)] == [True] * 5 and got[90_009]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and np.median([r["score"] for r in got.values()]) < 1 - 1e-6
    assert {i for i in known} == {i for i, _, _ in table[1] if zlib.crc32(str(i).encode()) % 4 == 2}
