"""Eigenpairs and whitening against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from argotlog.llm.catalog import op12_embedding_whitening
from argotlog.llm.eigen import below, largest, leading, tridiagonal
from argotlog.llm.whitening import whitened

FOLDER = "/root/testdata/sf0.001"


def matrices():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 17, 64):
        a = rng.normal(size=(3 * d, d))
        yield a.T @ a
        yield np.eye(d) * 3
        yield np.zeros((d, d))
        yield np.outer(a[0], a[0])
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        yield q @ np.diag(10.0 ** -np.arange(d).clip(0, 13)) @ q.T
        yield q @ np.diag(np.repeat([5.0, 5.0 + 1e-13, 1.0, 1e-9], d)[: 4 * d : 4]) @ q.T
        yield np.diag(np.arange(d) % 3.0)


@pytest.mark.parametrize("number,matrix", list(enumerate(matrices())))
def test_leading_pairs(number, matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading(matrix, 32)
    size = max(np.abs(matrix).max(), 1e-300)
    expected = np.linalg.eigvalsh(matrix)[::-1][:32]
    assert len(values) == len(expected) and np.abs(values - expected).max() <= 1e-13 * size * len(matrix)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-13 * size * len(matrix)


def test_tridiagonal_form_and_sturm_counts():
    a = np.random.default_rng(1).normal(size=(30, 9))
    a = a.T @ a
    d, e, _ = tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1)), values)
    between = (values[1:] + values[:-1]) / 2
    assert below(d, e, between).tolist() == list(range(1, 9))
    assert np.allclose(largest(d, e, 4), values[::-1][:4])


def brute(rows, k=32):
    """(n, S, values, trace, whitened up to sign) of a list of vectors."""
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return x, n, s, values, np.trace(covariance), centred @ axes / np.sqrt(values)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, s, values, trace, expected = brute([r["embedding"] for r in table])
    rows = op12_embedding_whitening(spark, FOLDER).orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * n and {r["n"] for r in rows} == {n} and [r["component"] for r in rows[:32]] == list(range(1, 33))
    got = np.array([r["whitened"] for r in rows]).reshape(n, 32)
    assert np.abs(got * np.sign((got * expected).sum(axis=0)) - expected).max() < 1e-8
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert [r["deviation"] for r in rows[::32]] == deviation
    assert np.allclose([r["explained"] for r in rows[:32]], values / trace, rtol=1e-6)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").select("*", *(F.lit(1).alias(c) for c in ("key", "v", "n", "component")))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 5), 1.0], 0) for i in range(30)]
    rows = [*good, good[4], (None, [0.5, 2.0, 1.0], None), (50, None, 1), (51, [1.0, None, 1.0], 1), (52, [nan, 1.0, 1.0], 1), (53, [1.0, -inf, 1.0], 1), (54, [1.0], 1), (55, [], 1)]
    found = whitened(vectors(spark, rows)).collect()
    fit = [r[1] for r in [*good, good[4], (None, [0.5, 2.0, 1.0])]]
    full = [r for r in found if r["component"]]
    # The third entry never varies, so two components are left; rows of another length have no component.
    assert len(full) == 2 * len(fit) and {r["n"] for r in full} == {len(fit)}
    assert sorted(r["vec_id"] for r in found if r["component"] is None) == [54, 55]
    assert len([r for r in full if r["vec_id"] == 4]) == 4 and len([r for r in full if r["vec_id"] is None]) == 2
    x, n, s, *_ = brute(fit, 2)
    assert {int(r["deviation"]) for r in full if r["vec_id"] == 7} == {int(((n * x[7] - s) ** 2).sum())}


def test_tables_without_spread(spark):
    assert whitened(vectors(spark, [])).count() == 0
    assert whitened(vectors(spark, [(1, [1.0, 2.0], 0)] * 5)).count() == 0
    assert whitened(vectors(spark, [(1, None, 0)])).count() == 0


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [1e9 * (i % 2), float(i), -1e30], 0) for i in range(40)]
    found = whitened(vectors(spark, rows)).where("component = 1").collect()
    x = np.floor(np.clip(64 * np.array([[np.float32(a) for a in r[1]] for r in rows], np.float64), -(2.0**36), 2.0**36)).astype(np.int64) + 1_000_000
    s = [sum(int(a) for a in column) for column in x.T]
    expected = {i: sum((40 * int(a) - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert max(expected.values()) > 2**63 and {r["vec_id"]: int(r["deviation"]) for r in found} == expected
