import math

import numpy as np
import pytest

from botlantern.llm import whitening
from botlantern.llm.whitening import jacobi, tournament, whiten, whitening_digest


def plain(rows, most=4):
    """The whitening by whole numbers and a symmetric eigensolver: {(vec_id, component): (n, deviation, whitened, explained)}."""
    dim = max(len(v) for _, v in rows if v)
    kept = [(i, [math.floor(256 * c) for c in v] + [0] * (dim - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], dtype=object).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    found = []
    for i, x in kept:
        whole = [n * c - s for c, s in zip(x, sums, strict=True)]
        y = (np.array(whole, dtype=object).astype(float) / n) @ vectors[:, ::-1][:, :most] / np.sqrt(values[::-1][:most])
        found += [(i, k + 1, n, sum(w * w for w in whole), y[k], values[::-1][k] / values.sum()) for k in range(most)]
    return found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(12, 12)) * np.geomspace(3, 0.05, 12)[:, None]
    rows = [(i, [float(c) for c in rng.normal(size=12) @ mix + 0.3]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)] + [(3, rows[3][1]), (None, rows[4][1]), (None, rows[5][1]), (7, rows[8][1])]
    rows += [(2000, None), (2001, rows[0][1][:11] + [None]), (2002, rows[0][1][:11] + [math.nan]), (2003, rows[0][1][:11] + [-math.inf]), (2004, [0.0] * 12), (2005, [-0.0] * 12), (2006, rows[9][1][:7]), (2007, [])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, x int")


def same(got, want):
    """Equal row by row, but for the sign of each component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted([tuple(r)[:6] for r in got], key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.mark.parametrize("fan, block", [(16, 4096), (2, 7)])
def test_against_an_eigensolver(spark, vectors, monkeypatch, fan, block):
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", block)
    got = whitening_digest(frame(spark, vectors).repartition(7)).collect()
    same(got, plain(vectors))
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_signs_are_the_same_for_all_rows_and_repeats(spark, vectors):
    df = frame(spark, vectors)
    a, b = ({(r.vec_id, r.component): r.whitened for r in whitening_digest(d).where('vec_id > 7').collect()} for d in (df, df.repartition(5)))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-8


def test_fewer_components_than_asked_for(spark):
    line = [(i, [i / 16, -i / 8, 0.0]) for i in range(50)]
    got = whiten(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    assert abs(np.var([r.whitened for r in got]) - 1) < 1e-9
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening_digest(frame(spark, rows)).collect() == []


def test_numbers_beyond_longs(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i), 3.0e15 * i]) for i in range(6)]
    got = whiten(frame(spark, rows), most=1).collect()
    assert len(got) == 6 and all(r.deviation is None or r.deviation >= 0 for r in got)
    small = [(i, [1e12 * i, 1.0]) for i in range(6)]
    n, s = 6, 256 * 10**12 * 15
    want = {i: (n * 256 * 10**12 * i - s) ** 2 for i in range(6)}
    assert {r.vec_id: int(r.deviation) for r in whiten(frame(spark, small)).collect()} == want
    assert {r.deviation for r in whitening_digest(frame(spark, small)).collect()} == {None}


def test_jacobi_finds_small_values_of_graded_matrices():
    rng = np.random.default_rng(0)
    for dim in (1, 2, 5, 33, 64):
        u, v = (np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(2))
        want = np.geomspace(1e6, 1e-4, dim)
        values, components = jacobi((u * want) @ v.T)
        assert np.allclose(values, np.sort(want)[::-1], rtol=1e-5)
        assert np.abs(components @ components.T - np.eye(dim)).max() < 1e-12
    assert jacobi(np.zeros((0, 3)))[0].tolist() == [0, 0, 0]
    # Columns of very different length: the short ones are as exact as the long ones.
    graded = np.linalg.qr(rng.normal(size=(20, 20)))[0] * np.geomspace(1, 1e-13, 20)
    assert np.allclose(jacobi(graded)[0], np.geomspace(1, 1e-13, 20), rtol=1e-12)


def test_each_pair_meets_once_in_a_sweep():
    for dim in (1, 2, 3, 8, 9):
        pairs = [tuple(p) for r in tournament(dim) for p in r.T.tolist()]
        assert sorted(pairs) == [(i, j) for i in range(dim) for j in range(i + 1, dim)]
        assert all(len(set(r.ravel().tolist())) == r.size for r in tournament(dim))
