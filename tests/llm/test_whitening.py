from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import whitening as W


def exact(x):
    """A double-double matrix as fractions."""
    return [[Fraction(float(a)) + Fraction(float(b)) for a, b in zip(r, s)] for r, s in zip(x[0].tolist(), x[1].tolist())]


def times(a, b):
    return [[sum(x * y for x, y in zip(row, column)) for column in zip(*b)] for row in a]


def test_products_keep_a_hundred_bits():
    rng = np.random.default_rng(1)
    a, b = (W.two_sum(rng.normal(size=(9, 9)) * 10.0 ** rng.integers(-6, 6, (9, 1)), rng.normal(size=(9, 9)) * 1e-18) for _ in "ab")
    found, wanted = exact(W.product(a, b)), times(exact(a), exact(b))
    scale = max(abs(v) for row in wanted for v in row)
    assert all(abs(f - w) <= scale * Fraction(1, 1 << 95) for r, s in zip(found, wanted) for f, w in zip(r, s))


def rotation(size, seed):
    """An orthogonal matrix to double-double precision."""
    q = W.whole(np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0])
    for _ in range(3):
        gap = W.add(W.whole(np.eye(size)), W.negative(W.product(W.transposed(q), q)))
        q = W.add(q, W.product(q, (gap[0] / 2, gap[1] / 2)))
    return q


SPECTRA = {
    "apart": [9.0, 7.5, 5.0, 3.25, 2.0, 1.0, 0.5, 0.25, 0.125, 0.0625],
    "near": [3.0, 3.0 + 1e-9, 3.0 - 1e-9, 2.0, 2.0 + 1e-12, 1.0, 1.0 + 1e-6, 0.5, 0.5 + 1e-10, 0.1],
    "nested": [1.0, 1.0 + 1e-8, 1.0 + 1e-8 + 1e-13, 1.0 - 1e-8, 0.5, 0.5 + 1e-13, 0.25, 0.2, 0.1, 0.05],
    "equal": [2.0, 2.0, 2.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.25],
    "without": [4.0, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "wide": [1e8, 1e4, 1.0, 1e-2, 1e-3, 1e-4, 1e-5, 1e-5 + 1e-12, 1e-6, 1e-7],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors_of_clustered_spectra(name):
    spectrum = np.array(SPECTRA[name])
    size = len(spectrum)
    q = rotation(size, 3)
    matrix = W.product(W.product(q, W.whole(np.diag(spectrum))), W.transposed(q))
    half = W.add(matrix, W.transposed(matrix))
    matrix = half[0] / 2, half[1] / 2
    values, vectors = W.refine(matrix, np.linalg.eigh(matrix[0].astype(np.float32))[1])
    assert np.allclose(values[0], np.sort(spectrum)[::-1], rtol=1e-14, atol=1e-14 * spectrum.max())
    residual = W.add(W.product(matrix, vectors), W.negative(W.product(vectors, W.whole(np.diag(values[0])))))
    left = np.abs(residual[0]).max()
    assert left <= 2.0**-52 * spectrum.max()  # the values were rounded to doubles
    square = W.product(W.transposed(vectors), vectors)
    assert np.abs(square[0] - np.eye(size)).max() < 1e-18
    # Off the diagonal nothing is left that a gap could magnify.
    inner = W.product(W.transposed(vectors), W.product(matrix, vectors))
    gaps = np.abs(values[0][:, None] - values[0][None, :])
    apart = gaps > spectrum.max() * 1e-14
    np.fill_diagonal(apart, False)
    loose = np.abs(inner[0])[apart] / gaps[apart]
    assert loose.max(initial=0.0) < 1e-12
    if name != "equal" and name != "without":  # known vectors, up to sign
        turn = np.abs(W.product(W.transposed(q), vectors)[0])
        order = np.argsort(-spectrum, kind="stable")
        assert np.abs(turn[order] - np.eye(size)).max() < 1e-12


def test_gram_is_exact_for_large_numbers():
    rng = np.random.default_rng(2)
    for most in (100, 1 << 24, 1 << 30, 1 << 44):
        x = rng.integers(-most, most, size=(37, 3))
        big = x.astype(object)
        assert (W.exact_gram(x) == big.T @ big).all()


def brute(rows):
    """(n, deviations, whitened, explained) with numpy from exact whole numbers."""
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    centred = off / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, (off**2).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(cov)


def make(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label string")


def test_query_equals_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    n, deviations, whitened, explained = brute(rows)
    found = W.op11_whitening(spark, sf_dir).collect()
    assert len(found) == len(rows) * 32
    at = {vec_id: i for i, (vec_id, _) in enumerate(rows)}
    ours = np.zeros((len(rows), 32))
    for r in found:
        assert r["n"] == n and r["deviation"] == deviations[at[r["vec_id"]]] and 0 <= r["identity_error"] < 1e-9
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
        ours[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((ours * whitened[:, :32]).sum(axis=0))
    assert np.abs(ours * signs - whitened[:, :32]).max() < 1e-8


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist(), None) for i in range(8)]
    odd = [(20, None, "x"), (21, [1.0, None, 2.0], ""), (22, [nan, 0.0, 0.0], None), (23, [inf, 0.0, 1.0], None)]
    odd += [(24, [1.0], None), (25, [], None), (None, [1.0, 2.0, 3.0], None), good[2]]
    df = make(spark, good + odd, "array<double>").withColumns({c: F.lit(c) for c in ("_id", "_v", "n", "component")})
    found = W.whiten(df).collect()
    assert len(found) == 10 * 3 and {r["n"] for r in found} == {10}
    assert sorted(r["vec_id"] for r in found if r["vec_id"] is not None) == sorted([*range(8), 2] * 3)
    rows = [(i, v) for i, v, _ in [*good, odd[6], good[2]]]
    _, deviations, whitened, _ = brute(rows)
    ours = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert all(abs(abs(ours[(i, k + 1)]) - abs(whitened[j, k])) < 1e-9 for j, (i, _) in enumerate(rows) for k in range(3))
    assert {r["deviation"] for r in found} == set(deviations.tolist())


def test_no_variance_and_few_vectors(spark):
    one = W.whiten(make(spark, [(1, [0.5, 0.25], None)])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(0.0, 0.0, 0, 0.0)] * 2
    two = W.whiten(make(spark, [(1, [0.0, 1.0, 1.0], None), (2, [1.0, 0.0, 1.0], None)])).collect()
    assert sorted(abs(r["whitened"]) for r in two) == pytest.approx([0, 0, 0, 0, 1, 1], abs=1e-12)
    assert all(r["identity_error"] < 1e-12 for r in two)
    assert W.whiten(make(spark, [])).collect() == [] and W.whiten(make(spark, [(1, None, None)])).collect() == []


def test_large_components(spark):
    rows = [(i, [float(v), 1.0 * i], None) for i, v in enumerate([0.0, 3e14, -3e14, 1e300])]
    found = W.whiten(make(spark, rows, "array<double>")).collect()
    assert len(found) == 8 and all(np.isfinite(r["whitened"]) for r in found)
    assert any(r["deviation"] is None for r in found)


def test_layout_does_not_matter(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    take = lambda df: {(r["vec_id"], r["component"]): r["whitened"] for r in W.whiten(df).collect()}
    first, second = take(table), take(table.repartition(7))  # rows next to each other may round their last bit apart
    assert first.keys() == second.keys() and all(abs(first[k] - second[k]) < 1e-13 for k in first)
