"""Registered queries against their SQL, and the pipeline against plain versions of its stages."""

import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fieldloom.llm import packing, quality, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, same_rows, name):
    same_rows(registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


def test_pipeline(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    verdict = brute.quality(rows, quality.LINE_DOCS, quality.LEFT_PERCENT)
    texts = [(i, v[3]) for (i, _, _), v in zip(rows, verdict) if v[1]]
    texts = [(i, x[2]) for i, x in brute.lines(texts).items()]
    groups = brute.near(texts, 5)
    texts = [(i, t) for i, t in texts if groups[i][1] == i]
    texts = {i: x[3].decode("utf-8", "ignore") for i, x in brute.passages(texts).items()}
    own = packing.WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.append(own.encode(pa.array([t]))[0], 2).astype("<u4") for i, t in texts.items()}
    expected = {i: len(x) for i, x in ids.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in got)
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == expected
    assert sum(r["length"] for r in got) == sum(expected.values())


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
        out = stage(spark, docs.limit(30), sf_dir)
        assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
