"""Whitening against numpy's dense eigenvalues; inertia counts and iteration on matrices made for trouble."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from sigmark.llm import whitening
from sigmark.llm.queries import QUERIES
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def expected(rows: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, deviations, eigenvalues and whitened rows."""
    own = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, s = len(own), [sum(c) for c in zip(*[v for _, v in own], strict=True)]
    exact = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for _, v in own]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for _, v in own])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in own], exact, values, y @ vectors[:, :8] / np.sqrt(np.maximum(values[:8], 1e-300))


def check(got: list, rows: list[tuple], components: int = 8) -> None:
    ids, exact, values, white = expected(rows)
    assert len(got) == components * len(rows)
    place = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        k = place[r.vec_id]
        assert (r.n, r.deviation) == (len(rows), exact[k])
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        want = white[k, r.component - 1]
        if abs(want) > 1e-6:
            sign = signs.setdefault(r.component, math.copysign(1, r.whitened * want))
            assert math.isclose(sign * r.whitened, want, rel_tol=1e-6, abs_tol=1e-7)
        assert 0 <= r.identity_error < 1e-8


def test_registered(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    check(QUERIES["op12_embedding_whitening"](spark, DATA).collect(), usable)


def test_awkward(spark):
    rng = np.random.default_rng(2)
    good = [(k, [float(np.float32(x)) for x in rng.normal(0.1, 1 + np.arange(12) / 3)]) for k in range(200)]
    bad = [(300, None), (301, [1.0] * 11 + [None]), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (304, []), (305, [1.0] * 5), (306, [2.0] * 13), (None, None)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + bad], SCHEMA).repartition(3)
    check(whitening.whiten(df).collect(), good)


def test_repeats_and_ties(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [3.0, 2.0]), (4, [3.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2))
    assert max(r.identity_error for r in got) < 1e-10
    # of two lengths equally common the greater counts
    both = [(1, [0.0, 1.0]), (2, [1.0, 3.0]), (3, [0.0, 1.0, 2.0]), (4, [5.0, 1.0, 7.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, 0, "") for r in both], SCHEMA)).collect()
    assert {(r.vec_id, r.component, r.n) for r in got} == {(3, 1, 2), (4, 1, 2)}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_to_scale(spark, rows):
    assert whitening.whiten(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)).collect() == []


def test_large_entries(spark):
    """Entries near a float's end, and deviations beyond a long."""
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA)).collect()
    assert {r.deviation for r in got if r.vec_id in (1, 2)} == {None} and all(r.deviation is not None for r in got if r.vec_id > 2)
    assert whitening._deviation(np.array([[3_037_000_499], [3_037_000_500]]), 1, np.array([0])).to_pylist() == [3_037_000_499**2, None]


def matrices():
    rng = np.random.default_rng(7)
    q = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    for values in (np.arange(20.0), np.full(12, 3.0), np.r_[5.0, 5.0, 5.0, np.full(9, 1.0)], np.r_[1e6, 1e6 * (1 - 1e-9), 1.0, np.zeros(10)], 10.0 ** -np.arange(0, 16), np.r_[np.full(10, 2.0), np.full(10, 2.0 - 1e-13)], np.zeros(6), np.r_[1.0]):
        turn = q(len(values))
        yield values, turn @ np.diag(values) @ turn.T
    yield np.array([4.0, 3.0, 0.0]), np.diag([3.0, 0.0, 4.0])


def test_spectrum():
    for values, a in matrices():
        a = (a + a.T) / 2
        got, vectors = whitening.Spectrum(a).leading(8)
        want = np.sort(values)[::-1]
        want = want[want > 2e-12 * max(want[0], 1e-300)][:8]
        assert abs(len(got) - len(want)) <= 1 and np.allclose(got, want[: len(got)], rtol=0, atol=1e-10 * want.max(initial=1e-300))
        assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-9)
        assert np.allclose(a @ vectors, vectors * got, atol=1e-9 * want.max(initial=1e-300))


def test_inertia():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 8, 40):
        for _ in range(20):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if rng.random() < 0.5:
                np.fill_diagonal(a, 0)  # needs pivots of two rows
            assert whitening.inertia(a) == int((np.linalg.eigvalsh(a) < 0).sum())
    assert whitening.inertia(np.zeros((4, 4))) == 0 and whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


def test_moments():
    x = np.random.default_rng(3).integers(0, 10**6, (1000, 5)) + 10**9
    m = whitening.Moments(5)
    for part in np.array_split(x, 7):
        m.add(part)
    want = np.cov(x.T, bias=True)
    assert m.n == 1000 and (m.sum == x.sum(0)).all() and np.allclose(m.m / 1000, want, rtol=0, atol=1e-12 * want.max())
