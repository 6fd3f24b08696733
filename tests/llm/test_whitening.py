"""Whitened embeddings against another library's eigenvectors and exact whole numbers."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import whitening


def plain(vectors, k=4):
    """n, S, deviation for each x, eigenvalues, components and trace over the distinct vectors."""
    xs = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = np.array(sorted(set(xs)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(v) for v in row] for row in fit]) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs}
    return xs, n, np.array([s / n for s in sums]), deviation, values[::-1][:k], axes.T[::-1][:k], values.sum()


def held(rows, ids, vectors, k=4):
    xs, n, mean, deviation, values, axes, trace = plain(vectors, k)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["vec_id"], r["component"]].append(r)
    signs = {}
    for i, x in zip(ids, xs):
        for c in range(k):
            r = next(r for r in got[i, c + 1] if r["deviation"] == deviation[x])
            got[i, c + 1].remove(r)
            score = (np.array(x, float) - mean) @ axes[c] / math.sqrt(values[c])
            if abs(score) > 1e-3:
                assert signs.setdefault(c, np.sign(score * r["whitened"])) == np.sign(score * r["whitened"])
            assert r["n"] == n
            assert abs(abs(r["whitened"]) - abs(score)) < 1e-9 and abs(r["explained"] - values[c] / trace) < 1e-9 * values[c] / trace and r["identity_error"] < 1e-8
    assert not any(got.values())


def test_whitened_query(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    held(whitening.op11_embedding_whitening(spark, sf_dir).collect(), [r[0] for r in own], [r[1] for r in own])


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in rng.normal(0, [3, 2, 1, 0.5, 0.2, 0.1])]) for i in range(40)]
    good += [(5, good[5][1]), (5, good[6][1]), (None, good[7][1]), (90, good[8][1]), (91, [1e4, -1e4, 0.0, 0.0, -0.0, 0.0])]
    bad = [(70, None), (71, []), (72, [1.0] * 5 + [None]), (73, [float("nan")] * 6), (74, [1.0] * 5 + [float("inf")]), (75, [1.0] * 5), (76, [1.0] * 7)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("n", "component", "WHITENED", "x", "id", "vector", "i")})
    held(whitening.whitened(df).collect(), [i for i, _ in good], [v for _, v in good])


def test_vectors_without_variance(spark):
    """One vector, equal ones, ones that lie on a line, ones of two dimensions, and numbers beyond a long."""
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, 0.0, None)] * 4
    got = whitening.whitened(df([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3} and all(abs(r["explained"] - 1) < 1e-12 for r in got if r["component"] == 1)
    held(whitening.whitened(df([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.5, 0.5])])).collect(), [1, 2, 3], [[1.0, 2.0], [3.0, 1.0], [0.5, 0.5]], 2)
    got = whitening.whitened(df([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 0.0])])).collect()
    assert len(got) == 6 and {r["deviation"] is None for r in got} == {True, False} and {r["vec_id"] for r in got if r["deviation"] is None} == {1, 2}


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 1, 0.5], [5, 5, 4, 1e-3, 0, 0], [1, 1 - 1e-12, 1 - 2e-12, 1 - 3e-12, 1e-9, 1e-9], [3, 2, 1], [7]])
def test_close_eigenvalues(values):
    d, k = len(values), min(4, len(values))
    turn = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    a = turn @ np.diag(values) @ turn.T
    for matrix in (a, np.diag(np.array(values, float)), np.zeros((d, d))):
        got, axes = whitening.leading_vectors((matrix + matrix.T) / 2, k)
        assert np.allclose(got, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-13 * 10)
        assert np.abs(axes @ axes.T - np.eye(k)).max() < 1e-12
        assert np.abs(axes @ matrix @ axes.T - np.diag(got)).max() < 1e-12 * max(values) * 10
