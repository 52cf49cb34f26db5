"""Sliced spectra and whitened vectors against numpy's eigenvalues and plain whole numbers."""

import math
import random

import numpy as np
import pytest

from racebook.llm import plans, spectrum, whitening

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, n STRING, component DOUBLE"


def test_inertia_counts_negative_eigenvalues():
    rng = np.random.default_rng(4)
    for _ in range(60):
        d = int(rng.integers(1, 30))
        b = rng.standard_normal((d, d)) * 10.0 ** rng.integers(-5, 5)
        b = b + b.T
        if rng.random() < 0.3:
            np.fill_diagonal(b, 0)
        assert spectrum.below_zero(b) == (np.linalg.eigvalsh(b) < 0).sum()
    assert spectrum.below_zero(np.array([[0.0, 1], [1, 0]])) == 1 and spectrum.below_zero(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("case", range(24))
def test_leading_pairs(case):
    rng = np.random.default_rng(case)
    d = [1, 2, 5, 17, 64][case % 5]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.abs(rng.standard_normal(d)) * 10.0 ** int(rng.integers(-6, 6))
    if case % 3 == 1:
        e[: d // 2 + 1] = e[0]  # equal ones
    if case % 4 == 2 and d > 1:
        e[2:] = 0
        e[:2] = e[0], e[0] * (1 + 1e-13)  # as good as equal
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = spectrum.leading(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    assert len(values) == (want > 1e-13 * want[0]).sum()
    assert np.allclose(values, want[: len(values)], rtol=1e-11)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0] * d
    assert len(spectrum.leading(np.zeros((d, d)), 4)[0]) == 0


def odd_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.3 * (j % 3), 0.05 + 0.1 * (j == 2)) for j in range(6)]) for i in range(200)]
    rows += [(300, None), (301, [None] * 6), (302, [1.0, float("nan")] * 3), (303, [float("inf")] + [0.0] * 5), (304, []), (305, [0.5, 0.25]), (306, [0.5, 0.25, 0.0])]
    rows += [(None, [0.1] * 6), (7, [0.2] * 6), rows[3], rows[3], (307, [-0.001, 9.0, 0.0, 0.0, 0.0, -0.0]), (308, [1e30] * 6)]
    return [(i, v, "clash", 1.5) for i, v in rows]


def plain(rows, d):
    x = [(i, [math.floor(256 * np.float32(c).astype(float)) for c in v] + [0] * (d - len(v))) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    return x, n, sums, e[::-1], axes[:, ::-1], np.trace(v)


def test_whitened_equal_plain_version(spark):
    rows = odd_vectors()
    got = plans.op12_whitening(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    x, n, sums, e, axes, trace = plain(rows, 6)
    assert len(got) == 4 * len(x)
    want = {}
    for i, v in x:
        dev = sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums))
        for k in range(4):
            want.setdefault((i, k + 1), []).append((dev, float((np.array(v) - sums / n) @ axes[:, k] / math.sqrt(e[k]))))
    signs = {}
    for r in got:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9
        dev, z = min(want[r.vec_id, r.component], key=lambda w: (w[0] != r.deviation, abs(abs(w[1]) - abs(r.whitened))))
        assert dev == r.deviation and abs(abs(z) - abs(r.whitened)) < 1e-7 * max(1, abs(z))
        if abs(z) > 1e-3:
            assert signs.setdefault(r.component, z * r.whitened > 0) == (z * r.whitened > 0)


def test_few_or_no_vectors(spark):
    for rows in ([], [(1, None, "", 0.0)], [(1, [], "", 0.0)], [(1, [0.5, 0.5], "", 0.0)] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0], "", 0.0), (2, [0.0, 0.0], "", 0.0)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, int(r.deviation), round(abs(r.whitened), 12)) for r in two) == [(1, 1, 256**2, 1.0), (2, 1, 256**2, 1.0)]


def test_packed_vectors_and_large_sums(spark):
    x = np.array([[1, -3, 0, 0], [1 << 40, 0, 5, 0], [0, 0, 0, 0], [-(1 << 15), 2, 0, 9]])
    raw = whitening.pack(x)
    assert raw == whitening.pack(np.pad(x, ((0, 0), (0, 3)))) and (whitening.unpack(raw, 4) == x).all()
    big = (1 << 61) + 7
    assert whitening.deviations(np.array([[big, -big]]), 3, [5, -big]) == [(3 * big - 5) ** 2 + (-3 * big + big) ** 2]
    fit = spark.createDataFrame([(bytearray(r),) for r in whitening.pack(np.array([[big, -big, -1]] * 40))], "x BINARY")
    assert whitening.totals(fit) == (40, [40 * big, -40 * big, -40])


def test_a_vector_that_most_rows_share(spark):
    rows = [(i, [0.1, 0.2, 0.3] if i % 3 else [i / 97, (i * i % 31) / 31, 0.5 + i / 1000], "", 0.0) for i in range(900)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), k=3)
    assert got.count() == 2700 and got.first().n == 301 and got.first().identity_error < 1e-9
