"""Every operator and stage on the rows that tables may hold: repeated ones, texts under one doc_id, nulls, a very long text, columns named like results, none at all."""

import collections

import brute
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from fieldloom.llm import bpe, exact, html, langid, lines, minhash, packing, quality, suffix, warc

#: Names of results and helper columns of the operators, in several cases.
CLASHES = ["n_lines", "n_dropped", "KEPT_SHA256", "n_bytes", "n_removed", "n_spans", "kept_text", "kept", "n_words", "content", "row", "hash", "base", "id", "key", "h1", "shard", "label", "sig", "bands", "start", "length", "salt", "rank", "_sha1", "host", "n_shingles", "component_id", "keep_id", "text_sha256", "n_tokens", "lang_pred", "score", "ids", "decoded", "fp", "copies", "task", "piece", "N_SHARED_WORDS"]
TOKENS = P.path("word_bpe_49k.json")


def rows_of():
    """(doc_id, text, lang, source): every case, with a text of over 2 MB that shares passages and lines."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage = " ".join(word(6) for _ in range(40))
    line = "one line of many documents to be found"
    words = [word(int(n)) for n in rng.integers(2, 9, 300_000)]
    long = " ".join(words) + " " + passage + "\n" + line + "\n" + " ".join(words[:300_000:3])
    assert len(long) > 2 << 20
    text = f"{line}\n{passage}\n" + " ".join(word(5) for _ in range(60))
    return [
        (5, text, "en", "a"), (5, text, "en", "a"), (5, text, "en", "a"), (7, passage + "\n" + line.upper(), "en", "a"), (7, "another text of seven\n" + passage, "fr", "b"), (3, "", "de", None), (3, None, "de", "a"), (None, text, None, "a"), (None, None, None, None),
        (2, text.replace("one", "ONE"), "en", "a"), (9, long, "en", "a"), (1, line, "fr", "b"), (6, long[: 200_000] + " end", "fr", "a"),
    ]


@pytest.fixture(scope="session")
def given():
    return rows_of()


@pytest.fixture(scope="session")
def table(spark, given):
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def sorted_rows(rows):
    return sorted(rows, key=repr)


def test_exact_and_bpe(table, given):
    norm = lambda t: brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = collections.defaultdict(list)
    for i, t, *_ in given:
        ids[norm(t)].append(i)
    first = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    got = exact.exact_groups(table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows((i, first[norm(t)], len(ids[norm(t)]), i is None or i == first[norm(t)], brute.sha(norm(t).encode())) for i, t, *_ in given)
    import base64

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    ids = {t: np.array(own.encode_ordinary(t or ""), "<u4") for _, t, *_ in given}
    got = bpe.round_trip(table, path, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows((i, len(ids[t]), brute.sha(ids[t].tobytes()), brute.sha((t or "").encode())) for i, t, *_ in given)


def test_near_duplicates(table, given):
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(table, 2).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    sets = [(i, brute.shingle_set(t, 2)) for i, t, *_ in given if i is not None]
    assert {i: sorted(n for n, *_ in v) for i, v in got.items()} == {i: sorted(len(s) for j, s in sets if i == j) for i, _ in sets}
    # the two texts of 7, of which one is near nothing, are one document; 5 and 2 have equal sets but for the case of letters
    assert {i: {c for n, c, _ in v if n} for i, v in got.items()} == {5: {2}, 2: {2}, 7: {7}, 3: set(), 9: {9}, 1: {1}, 6: {6}}


def test_rows_of_one_document_bring_its_links_together(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(4, a), (4, b), (2, a + " x"), (3, b + " y"), (9, b), (8, "c d e")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df, 2).collect()} == {(4, 2), (2, 2), (3, 2), (9, 2), (8, 8)}


def test_passages(spark, table, given):
    number = lambda t: int(np.uint64(xxhash.xxh64((t or "").encode(), seed=42).intdigest()).view(np.int64)) if t is not None else 42
    named = sorted({(i, number(t), t) for i, t, *_ in given if i is not None}, key=lambda x: x[:2])
    plain = brute.passages([(k, t) for k, (_, _, t) in enumerate(named)])
    expected = {(i, t): plain[k] for k, (i, _, t) in enumerate(named)} | {(i, t): (len((t or "").encode()), 0, 0, (t or "").encode()) for i, t, *_ in given if i is None}
    got = suffix.remove_repeats(table.drop("KEPT_SHA256"), group_pieces=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows((i, *expected[i, t][:3], brute.sha(expected[i, t][3])) for i, t, *_ in given)
    # a repeated row loses what it loses alone
    alone = spark.createDataFrame([(5, ("word " * 30 + "\n") * 3)], "doc_id long, text string")
    one = suffix.remove_repeats(alone).collect()
    assert suffix.remove_repeats(alone.union(alone)).collect() == one * 2 and one[0]["n_removed"] > 100


def test_lines(table, given):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(brute.SPACE).translate(brute.LOWER)
    for i, t, *_ in given:
        for x in (t or "").split("\n") if i is not None else ():
            holders[key(x)].add(i)
    gone = lambda i, x: i is not None and len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
    kept = [[x for x in (t or "").split("\n") if not gone(i, x)] for i, t, *_ in given]
    got = lines.drop_repeated_lines(table).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "key").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows((i, t.count("\n") + 1 if t else 1, (t.count("\n") + 1 if t else 1) - len(k), brute.sha("\n".join(k).encode()), "own key") for (i, t, *_), k in zip(given, kept))
    assert sum(r["n_dropped"] for r in got) > 4


def test_lines_of_two_documents_stay(spark):
    df = spark.createDataFrame([(1, "a line of over twenty characters"), (2, "a line of over twenty characters"), (2, "a line of over twenty characters")], "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    assert [r["n_dropped"] for r in lines.drop_repeated_lines(df).collect()] == [0, 0, 0]


def test_quality(table, given):
    rows = [(i, t, h) for i, t, _, h in given]
    expected = brute.quality(rows, 2, 20)
    got = quality.cleaned(table, line_docs=2).select("doc_id", "base_failed", "kept", "n_shared_words", F.sha2("text", 256), "n_words", "key").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows((i, f, k, n, brute.sha(x.encode()) if t is not None else None, len(brute.WORD.findall(t or "")), "own key") for (i, t, _), (f, k, n, x) in zip(rows, expected))


def test_packing(table, given):
    own = packing.WordTokenizer.load(TOKENS)
    ids = [own.encode(pa.array([t], pa.string()))[0].tolist() + [2] for _, t, *_ in given]
    parts = packing.pack(packing.stored(packing.pieces(table, TOKENS, ids=True))).collect()
    assert sum(r["length"] for r in parts) == sum(map(len, ids))
    assert collections.Counter((r["doc_id"], r["doc_tokens"], r["start"], tuple(r["ids"])) for r in parts) == collections.Counter((i, len(x), a, tuple(x[a : a + 4096])) for (i, *_), x in zip(given, ids) for a in range(0, len(x), 4096))


def test_language(table, given):
    got = langid.predict(table, langid.train(table.where("doc_id is not null"))).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, *_ in given)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 3} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] == 9} == {"en"}


def test_stages_keep_columns_and_nulls(spark, table, given):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
        assert all((r["n_chars"] is None) == (r["text"] is None) and r["n_chars"] == len(r["text"] or "") for r in rows if r["text"] is not None)
    stages = dict(corpus_pipeline.STAGES)
    # a rejected row goes and its document's other rows stay
    words = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, words, "en", "a", 9), (1, "few", "en", "a", 3), (None, "few", "en", "a", 3), (None, words, "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted_rows((r["doc_id"], r["n_chars"]) for r in stages["quality rules"](spark, df, "").collect()) == sorted_rows([(1, 9), (None, 9)])
    assert [r["text"] for r in stages["line dedup"](spark, df.withColumn("text", F.lit(None).cast("string")), "").collect()] == [None] * 4


def test_pages(spark):
    """The page operators on repeated pages, nulls and columns of their own."""
    pages = [(7, "http://a", "x"), (7, "http://a", "x"), (3, "http://b", "x"), (5, "u", "x"), (5, "u", "y"), (None, "n", "x"), (4, None, None), (2, "e", ""), (8, "http://c", "<p>" + "Many words stand here, one by one. " * 80_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("archive", "refers_to", "record_type", "_sha1", "text", "n_chars", "digest", "block")})
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.revisits(df).collect()]
    last = {"x": 7, "y": 5, "": 4}
    revisit = lambda i, h: i is not None and last.get(h or "", i) != i
    assert sorted_rows(rows) == sorted_rows((i, len(h or ""), warc.digest((h or "").encode()), "revisit" if revisit(i, h) else "response", last[h or ""] if revisit(i, h) else None) for i, _, h in pages)
    got = html.main_text(df, html.fit(None, generated=40)).collect()
    assert collections.Counter(r["page_id"] for r in got) == collections.Counter(i for i, *_ in pages) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert {(r["text"], r["n_chars"]) for r in got if r["page_id"] in (4, 2)} == {("", 0)}
    assert all(r["n_chars"] > 2 << 20 for r in got if r["page_id"] == 8)


def test_empty_tables(spark, table, tmp_path):
    """Every query and the whole pipeline on tables without rows."""
    from fieldloom.llm import registry

    table.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
