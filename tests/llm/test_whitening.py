"""Spectrum slicing and whitening against numpy's own eigenvectors."""

import math
import random

import numpy as np
import pytest

from leafspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(6))
def test_counts_above(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((9, 9))
    a = a + a.T
    if seed % 2:
        np.fill_diagonal(a, 0)  # pivots of two rows
    values = np.linalg.eigvalsh(a)
    for shift in [-100, *((values[1:] + values[:-1]) / 2), 0.1, 100]:
        assert whitening.count_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, .5], [9, 9, 9, 1, 1, 0], [1, 1 - 1e-13, 1 - 2e-13, .5, 0, 0], [1e-9, 1e-12, 0, 0, 0, 0], [0] * 6, [1e6, 1, 1e-3, 1e-3, 0, -1], [7, 7 - 1e-9, 1, 1, 1, 1]])
def test_leading(values):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((6, 6)))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a, 4)
    if not any(values):
        assert len(got) == 0
        return
    scale = np.abs(values).max()
    assert got == pytest.approx(sorted(values, reverse=True)[:4], abs=1e-13 * scale)
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-13
    assert np.abs(vectors @ a - got[:, None] * vectors).max() < 1e-13 * scale


def plain(rows, k=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in distinct])
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    return kept, x, n, sums, values[::-1][:k], vectors[:, ::-1].T[:k], np.trace(cov)


def test_whiten(spark):
    rng = random.Random(6)
    mixing = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(20)]
    rows = []
    for i in range(400):
        base = [rng.gauss(0, 1.5 / (1 + k)) for k in range(20)]
        rows.append((i, [sum(m * b for m, b in zip(line, base)) for line in mixing]))
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(None, rows[4][1]), (7, rows[8][1])]
    rows += [(2000, None), (2001, [float("nan")] * 20), (2002, [None] + [0.0] * 19), (2003, [float("inf")] * 20), (2004, [1.0]), (2005, []), (2006, [3e38] * 20)]
    got = whitening.whiten(frame(spark, rows).repartition(6)).collect()
    good = [r for r in rows if r[0] not in range(2000, 2007)]
    kept, x, n, sums, values, vectors, trace = plain(good)
    assert len(got) == 16 * len(kept)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for (i, _), v in zip(kept, x):
        for c in range(16):
            r = by[i, c + 1][0] if i not in (7,) else min(by[i, c + 1], key=lambda r: abs(r["deviation"] - sum((n * a - s) ** 2 for a, s in zip(v, sums))))
            want = float((np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ vectors[c]) / math.sqrt(values[c]))
            sign = signs.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
            assert r["whitened"] == pytest.approx(sign * want, abs=1e-7)
            assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums)) and r["n"] == n
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whiten_degenerate(spark):
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.0])]).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 1.0])] * 5)).count() == 0  # one distinct vector has no spread
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(50)])).collect()  # rank one
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1) and len(line) == 50


def test_deviation_beyond_64_bits():
    model = whitening.Whitening(10**6, [10**12, 5], np.ones(1), np.array([[1.0, 0.0]]), 1.0)
    out = model.deviation(np.array([[10**6, 0], [10**9, 0], [10**6 + 3, 1]]))
    assert out[0] == 25 and out.mask.tolist() == [False, True, False] and out[2] == 9 * 10**12 + (10**6 - 5) ** 2
