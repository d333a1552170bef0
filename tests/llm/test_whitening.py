"""Whitening by block Lanczos against a dense decomposition."""

import math

import numpy as np
import pytest

from tidewright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string, n int, deviation int, whitened int"


def table(spark, vectors, partitions=3):
    return spark.createDataFrame([(i, v, 1, 1, "x", 1, 1, 1) for i, v in vectors], SCHEMA).repartition(partitions)


def dense(vectors):
    """Plain integers, the covariance of the distinct ones, and its decomposition."""
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), float)
    c = fit - fit.mean(0)
    values, columns = np.linalg.eigh(c.T @ c / len(fit))
    return x, sorted(set(x)), values[::-1], columns[:, ::-1]


def test_whitened_rows_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 24)) * np.linspace(3, 0.3, 24)
    vectors = [v.tolist() for v in base] + [base[3].tolist()] * 200
    bad = [(900, None), (901, [None] + [1.0] * 23), (902, [float("nan")] + [1.0] * 23), (903, [float("inf")] * 24), (904, []), (905, [1.0, 2.0]), (None, vectors[0])]
    df = table(spark, [*enumerate(vectors), *bad])
    fitted = whitening.fit(df, components=16, block=5)
    x, distinct, values, columns = dense(vectors)
    n = len(distinct)
    sums = [sum(v[k] for v in distinct) for k in range(24)]
    assert fitted.n == n and list(fitted.sums) == sums and fitted.identity_error < 1e-9
    np.testing.assert_allclose(fitted.values, values[:16], rtol=1e-12)
    rows = whitening.long_form(whitening.apply(df, fitted), fitted).collect()
    assert len(rows) == (len(vectors) + 1) * 16 and sum(r.vec_id is None for r in rows) == 16
    signs = {}
    for r in rows:
        i, k = r.vec_id or 0, r.component - 1
        c = [n * a - s for a, s in zip(x[i], sums)]
        assert r.deviation == sum(d * d for d in c) and r.n == n
        want = np.array(c) / n @ columns[:, k] / np.sqrt(values[k])
        sign = signs.setdefault(k, 1 if want * r.whitened >= 0 else -1)
        assert r.whitened == pytest.approx(sign * want, rel=1e-8, abs=1e-8)
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-10)


@pytest.mark.parametrize("block", [1, 2, 7, 40])
def test_lanczos_of_multiple_and_missing_eigenvalues(block):
    rng = np.random.default_rng(2)
    for spectrum in ([5.0] * 10 + [1.0] * 20, [9.0, 4.0, 1.0] + [0.0] * 27, np.linspace(1, 0, 30), [0.0] * 30, 0.5 ** np.arange(30)):
        q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
        a = q * np.array(spectrum) @ q.T
        values, vectors, passes = whitening.lanczos(lambda v: a @ v, 30, 8, block)
        np.testing.assert_allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-11)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-11)
        np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-11)
        assert passes <= 30 // block + 1
        far, _, _ = whitening.lanczos(lambda v: 1e20 * (a @ v), 30, 8, block)
        np.testing.assert_allclose(far, 1e20 * values, atol=1e9)


def test_early_end_by_residuals():
    a = np.diag(np.concatenate((np.arange(100, 84, -1) * 1e6, np.linspace(1, 0.5, 400))))
    values, _, passes = whitening.lanczos(lambda v: a @ v, 416, 16, 16)
    np.testing.assert_allclose(values, np.arange(100, 84, -1) * 1e6, rtol=1e-12)
    assert passes <= 8


def test_few_vectors_and_edges(spark):
    one = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    fitted = whitening.fit(one)
    assert fitted.n == 1 and len(fitted.values) == 0
    assert whitening.apply(one, fitted).count() == 2 and whitening.long_form(whitening.apply(one, fitted), fitted).count() == 0
    none = table(spark, [(1, None)])
    assert whitening.fit(none) is None and whitening.long_form(whitening.apply(none, None), None).count() == 0
    three = table(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [5.0])])
    fitted = whitening.fit(three)
    assert len(fitted.values) == 2 and fitted.identity_error < 1e-9  # three points span a plane
    rows = whitening.long_form(whitening.apply(three, fitted), fitted).collect()
    assert {(r.vec_id, r.component) for r in rows} == {(i, k) for i in (1, 2, 3) for k in (1, 2)}


def test_huge_entries_stay_exact(spark):
    df = table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [2.0**40, 3.0])])
    fitted = whitening.fit(df)
    x = {1: (2**52 + 1_000_000, 1_000_000), 2: (-(2**52) + 1_000_000, 1_000_064), 3: (2**46 + 1_000_000, 1_000_192)}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    assert list(fitted.sums) == sums
    for r in whitening.apply(df, fitted).collect():
        assert int(r.deviation) == sum((3 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
