"""The heavy-light join and the groups of spellings against plain versions."""

import collections
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rows import given, sorted_rows, table  # noqa: F401

from fieldloom.llm import jaccard, spelling


def test_classes_of_any_rows(table, given):  # noqa: F811
    got = collections.defaultdict(list)
    for r in jaccard.ngram_jaccard_classes(table, 4, 85).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    sets = [(i, brute.shingle_set(t, 4)) for i, t, *_ in given]
    assert {i: sorted(n for n, _ in v) for i, v in got.items()} == {i: sorted(len(s) for j, s in sets if i == j) for i, _ in sets}
    assert {i: {c for n, c in v if n} for i, v in got.items()} == {5: {2}, 2: {2}, 7: {7}, 3: set(), 9: {9}, 1: {1}, 6: {6}, None: {None}}


@pytest.mark.parametrize("percent", [60, 85])
@pytest.mark.parametrize("border", [None, 0, 15, 64])
def test_light_and_heavy_sets(spark, monkeypatch, percent, border):
    """Random sets about every boundary, of which many share frequent words; links as by comparing all pairs."""
    if border is not None:
        first = next(n for n in range(99) if jaccard.least_overlap(n, percent) >= jaccard.SUBSET)
        monkeypatch.setattr(jaccard, "light_sizes", lambda *_: (first, border))
    rng = np.random.default_rng(percent)
    texts = []
    for _ in range(60):
        base = [f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(1, 30))) % 90]
        texts += [" ".join(w for w in base if rng.random() > 0.06) + (" extra" if rng.random() < 0.3 else "") for _ in range(int(rng.integers(1, 5)))]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    got = jaccard.ngram_jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), 1, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near(docs, 1, percent)


def test_boundary_by_cost():
    counts = np.zeros(jaccard._CELLS, np.uint32)
    counts[:1000] = 50
    many = np.full(jaccard.LIGHT_LIMIT + 1, 100)
    first, last = jaccard.light_sizes(counts, many, 85)
    assert first == 2 and 13 <= last <= jaccard.LIGHT_LIMIT
    counts[:1000] = 1
    assert jaccard.light_sizes(counts, many, 85)[1] < last
    assert jaccard.light_sizes(counts, np.zeros_like(many), 85)[1] < first


def test_spellings_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = spelling.op13_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(brute.spellings(map(tuple, docs.collect())))


def test_spellings_of_any_rows(spark, table, monkeypatch):  # noqa: F811
    """Small leaves, so trees have many levels, those of words that letters can't tell apart too; long words, letters of two bytes, signs within runs."""
    monkeypatch.setattr(spelling, "LEAF", 4)
    monkeypatch.setattr(spelling, "LOW_LEAF", 2)
    rng = np.random.default_rng(5)
    words = ["".join(rng.permutation(list("abcdef"))) for _ in range(60)] + ["".join(rng.choice(list("aeiouéÉß×÷"), int(n))) for n in rng.integers(4, 9, 400)]
    long = "x" * 200 + "y" * 70_000
    words += [long, long + "z", "x" + long[2:], "q" * 62 + "r", "q" * 63 + "r", "q" * 64 + "r", "q" * 63 + "rs", "WORDS", "words", "wordS", "sword"]
    rows = [(int(i), " ".join(rng.choice(words[:-11], 40)) + " " + " ".join(words[-11:])) for i in rng.integers(0, 30, 60)] + [(None, "words " * 9), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("word", "N", "leaf", "form")})
    got = spelling.spelling_groups(df).collect()
    assert len(got) > 300 and sorted_rows(map(tuple, got)) == sorted_rows(brute.spellings(rows))
    monkeypatch.setattr(spelling, "LEAF", 512)
    monkeypatch.setattr(spelling, "LOW_LEAF", 32)
    assert sorted_rows(map(tuple, spelling.spelling_groups(df).collect())) == sorted_rows(map(tuple, got))


def test_checksums_of_runs():
    """Checksums put together from those of a document and a run are the library's."""
    crc = np.array([zlib.crc32(b"123:")], np.uint32)
    for b in "wörds".encode():
        crc = spelling._zeros_after(crc)
    assert crc[0] ^ zlib.crc32("wörds".encode()) == zlib.crc32("123:wörds".encode())
