from fractions import Fraction

import numpy as np
import pytest

from loomflow.llm import whitening

VECTORS = "vec_id bigint, embedding array<float>, x int, id string"


def plain(vectors, k=16):
    """n, deviations, covariance (exact) and eigenvalues of the fit list."""
    x = {i: tuple(int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v) for i, v in vectors.items()}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    far = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    cov = [[sum((Fraction(v[a]) - Fraction(sums[a], n)) * (Fraction(v[b]) - Fraction(sums[b], n)) for v in fit) / n for b in range(d)] for a in range(d)]
    v = np.array([[float(c) for c in row] for row in cov])
    return n, far, v, np.linalg.eigvalsh(v)[::-1][:k], x, sums


def test_matches_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20)) * np.linspace(3, 0.2, 20)
    vectors = {k: v.astype(np.float32).tolist() for k, v in enumerate(base)}
    vectors |= {100: vectors[3], 101: vectors[3]}
    bad = {200: None, 201: [1.0, None] + [0.0] * 18, 202: [float("nan")] * 20, 203: [float("inf")] * 20, 204: []}
    df = spark.createDataFrame([(k, v, 1, "clash") for k, v in (vectors | bad).items()], VECTORS).repartition(5)
    rows = whitening.whiten(df).collect()
    n, far, v, values, x, sums = plain(vectors)
    assert {r["vec_id"] for r in rows} == set(vectors) and len(rows) == 16 * len(vectors)
    assert {r["n"] for r in rows} == {n}
    assert all(int(r["deviation"]) == far[r["vec_id"]] for r in rows)
    assert {r["identity_error"] for r in rows}.pop() < 1e-9
    z = np.zeros((len(vectors), 16))
    at = {i: k for k, i in enumerate(vectors)}
    for r in rows:
        z[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-9
    # the projections on eigenvectors, but for their signs
    vectors_of = np.linalg.eigh(v)[1][:, ::-1][:, :16]
    want = np.array([[c - s / n for c, s in zip(x[i], sums)] for i in vectors]) @ (vectors_of / np.sqrt(values))
    want *= np.sign((want * z).sum(axis=0))
    assert np.allclose(z, want, atol=1e-8)


@pytest.mark.parametrize("bits", [3, 19, 40, 61, 150])
def test_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    size = 5000 if bits < 62 else 50
    u = np.array([[int(rng.integers(-(1 << 60), 1 << 60)) << bits >> 61 for _ in range(3)] for _ in range(size)], object)
    want = u.T.dot(u)
    if bits < 62:
        u = u.astype(np.int64)
    assert (whitening.products(u) == want).all()
    assert (whitening.squared_lengths(u[:50]) == (u[:50].astype(object) ** 2).sum(axis=1)).all()
    parts = whitening.limbs(u[:50])
    assert (sum(p.astype(np.int64).astype(object) * (1 << whitening.LIMB * k) for k, p in enumerate(parts)) == u[:50]).all()
    assert all(np.abs(p).max() <= 1 << whitening.LIMB for p in parts)


def test_lengths_flat_components_and_huge_entries(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0]), (None, [3.0, 2.0]), (4, [1e30, 0.0, -1e30]), (5, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((tuple(r) for r in whitening.whiten(df).collect()), key=str)
    two = [(r[0], r[1], r[2], round(abs(r[4]), 9), r[5], r[6]) for r in got if r[0] in (1, 2, None)]
    assert two == [(1, 1, 2, 1.0, 1.0, 0.0), (1, 2, 2, 0.0, 0.0, 0.0), (2, 1, 2, 1.0, 1.0, 0.0), (2, 2, 2, 0.0, 0.0, 0.0), (None, 1, 2, 1.0, 1.0, 0.0), (None, 2, 2, 0.0, 0.0, 0.0)]
    assert [(r[0], r[1], r[2], int(r[3]), r[4]) for r in got if r[0] == 3] == [(3, 1, 1, 0, 0.0)]
    assert len([r for r in got if r[0] in (4, 5)]) == 6
    assert whitening.whiten(df.limit(0)).collect() == []
