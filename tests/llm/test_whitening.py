"""Whitening against a dense eigensolver, exact sums and hand-made spectra."""

import math
import random

import numpy as np
import pytest

from faultfold.llm import whitening

NAMES = "vec_id long, embedding array<double>, dim int, x int, n int"


def brute(vectors):
    """{vec_id: (deviation, whitened by a dense solver)}, eigenvalues, n and the trace."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in fit])
    v = centred.T @ centred / n
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    out = {}
    for i, own in x.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))
        out[i] = deviation, (np.array([c - s / n for c, s in zip(own, sums, strict=True)]) @ columns)
    return out, values, n, float(np.trace(v))


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) * np.linspace(0.2, 2, 24)
    vectors = [(i, row.tolist()) for i, row in enumerate(base)]
    vectors += [(400 + i, vectors[7][1]) for i in range(40)] + [(500, [300.5] * 24)]
    bad = [(600, None), (601, [None] * 24), (602, [float("nan")] + [0.0] * 23), (603, [float("inf")] * 24), (604, [])]
    given = spark.createDataFrame([(*r, 0, 0, 0) for r in vectors + bad], NAMES).repartition(5)
    found = whitening.whiten(given).collect()
    want, values, n, trace = brute(vectors)
    assert len(found) == 16 * len(vectors) and {r["vec_id"] for r in found} == set(want)
    signs = {}
    for r in found:
        k = r["component"] - 1
        deviation, projected = want[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        expected = projected[k] / math.sqrt(values[k])
        if abs(expected) > 1e-3:
            signs.setdefault(k, set()).add(round(r["whitened"] / expected, 6))
        assert abs(r["whitened"]) == pytest.approx(abs(expected), abs=1e-8)
        assert r["identity_error"] < 1e-9
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 16


def matrix(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0] * 12 + [1.0] * 20,  # one eigenvalue many times over
        [10.0**-k for k in range(30)],
        [7.0] + [1e-9 * (1 + k) for k in range(25)],
        list(np.linspace(1, 2, 64)),
        [3.0, 3.0 + 1e-9, 3.0 - 1e-9, 1.0, 1.0],
        [4.0],
        [0.0] * 5,
    ],
)
def test_spectra(spark, values):
    v = matrix(values)
    found, vectors = whitening.eigenpairs(spark, v)
    want = sorted((e for e in values if e > 1e-12 * max(values)), reverse=True)[:16]
    got = found[: len(want)]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-13 * max(1e-300, max(values)))
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max(initial=0) < 1e-9
    assert np.abs(v @ vectors - vectors * found).max(initial=0) <= 1e-12 * max(values)


def test_inertia_counts():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 17, 40):
        a = rng.standard_normal((n, n))
        v = a + a.T
        values = np.linalg.eigvalsh(v)
        places = np.sort(rng.uniform(values.min() - 1, values.max() + 1, 50))
        assert whitening.below(whitening.tridiagonal(v), places).tolist() == [(values < p).sum() for p in places]


def test_a_missed_eigenvalue_is_an_error():
    v = matrix([5.0, 4.0, 3.0, 1.0])
    with pytest.raises(RuntimeError):
        whitening.feast(v, 2.0, 6.0, 2)


def test_packing_is_one_to_one():
    rng = random.Random(2)
    rows = np.array([[rng.choice((-1, 1)) * rng.randrange(1 << b) for b in (k, 3, 5)] for k in (1, 7, 8, 15, 16, 31, 32, 50)])
    packed = whitening.pack(rows)
    assert (whitening.unpack(packed, 3) == rows).all()
    assert packed == [whitening.pack(rows[i : i + 1])[0] for i in range(len(rows))]


def test_small_tables(spark):
    make = lambda rows: spark.createDataFrame([(*r, 0, 0, 0) for r in rows], NAMES)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(make([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0)]
    # Another length is fitted among itself.
    mixed = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [2.0]), (5, [9.0])])).collect()
    assert {r["vec_id"]: r["n"] for r in mixed} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
