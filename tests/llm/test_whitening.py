from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

VECTORS = "vec_id long, embedding array<double>, x string, n long, dim int, task int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], VECTORS)


def brute(rows, components=16):
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(n * x[k] - s[k]) for k in range(d)] for x in fit]) / n
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    out = {}
    for i, x in kept:
        out.setdefault(i, []).append((sum((n * x[k] - s[k]) ** 2 for k in range(d)), np.array([n * x[k] - s[k] for k in range(d)]) / n @ q / np.sqrt(values)))
    return n, values / np.trace(v), out


def check(spark, rows, near=1e-7):
    got = whitening.whiten(table(spark, rows)).collect()
    n, explained, want = brute(rows)
    k = len(explained)
    assert len(got) == k * sum(map(len, want.values()))
    signs = {}
    by_id = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9 and abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 * explained[0]
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for i, copies in want.items():
        for c in range(1, k + 1):
            assert len(by_id[i][c]) == len(copies)
            for r in by_id[i][c]:
                assert r["deviation"] in {dev for dev, _ in copies}
                one = next(w for dev, w in copies if dev == r["deviation"])[c - 1]
                if abs(one) > 1e-3:
                    assert signs.setdefault(c, np.sign(one) * np.sign(r["whitened"])) == np.sign(one) * np.sign(r["whitened"])
                assert abs(abs(r["whitened"]) - abs(one)) < near
    return got


def vectors(n, d, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(n, d)) * np.linspace(1, 4, d) * scale)]


def test_against_brute_force(spark):
    check(spark, vectors(300, 24))
    check(spark, vectors(50, 3))


def test_repeated_odd_and_null_vectors(spark):
    rows = vectors(200, 6)
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    copies = [(2000 + i, rows[0][1]) for i in range(150)] + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1])]
    got = check(spark, rows + odd + copies)
    one = {(r["component"], r["whitened"]) for r in got if r["vec_id"] == 0 or (r["vec_id"] or 0) >= 2000}
    assert len(one) == 6  # equal vectors, equal results
    short = whitening.whiten(table(spark, [*rows, (3000, [1.0, 2.0]), (3001, [])])).collect()
    assert {r["vec_id"] for r in short} == set(range(200))


def test_a_large_common_part_and_a_wide_spread(spark):
    rng = np.random.default_rng(3)
    spread = 10.0 ** np.linspace(6, -1, 8)
    mixed, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    x = rng.normal(size=(400, 8)) * spread @ mixed + 1e9
    got = whitening.whiten(table(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])).collect()
    assert all(r["identity_error"] < 1e-6 for r in got)
    grid = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in x.tolist()]
    n, s = len(grid), [sum(v[k] for v in grid) for k in range(8)]
    want = {i: sum((n * v[k] - s[k]) ** 2 for k in range(8)) for i, v in enumerate(grid)}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.integers(-(1 << 40), 1 << 40, size=(700, 5)), [[1, 2, 3, 4, 5]]])
    high, low = whitening.outer_products(x, np.zeros((5, 5)), np.zeros((5, 5)))
    exact = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert [[int(high[i, j]) + int(low[i, j]) for j in range(5)] for i in range(5)] == exact
    parts = whitening.limbs(x)
    assert len(parts) > 1 and (sum(p.astype(object) * (1 << whitening.LIMB * k) for k, p in enumerate(parts)) == x).all()
    assert all(np.abs(p).max() <= 1 << (whitening.LIMB - 1) for p in parts)


def test_eigen_beyond_double_precision():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values = [1e12, 1e9, 1e6, 1e3, 1.0, 1e-4]
    exact = [[sum(Fraction(q[i, k]) * Fraction(values[k]) * Fraction(q[j, k]) for k in range(6)) for j in range(6)] for i in range(6)]
    found, vectors_ = whitening.eigen(exact)
    assert np.abs(found / values - 1).max() < 1e-2 and np.abs(found[:4] / values[:4] - 1).max() < 1e-9
    assert np.abs(np.abs((vectors_ * q).sum(0)) - 1).max() < 1e-9


def test_without_variance_and_without_rows(spark):
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["n"] == 1 and r["identity_error"] == 0 for r in got)
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, [(1, None), (2, [None])])).collect() == []
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).collect() == []


@pytest.mark.parametrize("tasks", [1, 7])
def test_any_number_of_tasks_gives_the_same(spark, tasks):
    rows = vectors(120, 4)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table(spark, rows).repartition(tasks)).collect()}
    want = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(table(spark, rows[::-1])).collect()}
    assert got == want
