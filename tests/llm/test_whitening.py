"""FEAST whitening against a plain eigenvalue routine."""

import math

import numpy as np
import pytest

from misheard.llm import whitening
from misheard.llm.queries import QUERIES

KINDS = "vec_id long, embedding array<float>, component int, n int, v string"


def plain(rows, components=32):
    """whitened up to sign, deviation, eigenvalues."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    c = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    keep = e > 1e-10 * np.diag(cov).max()
    return c @ u[:, keep] / np.sqrt(e[keep]), deviation, e[keep], np.trace(cov)


def check(got, rows, components=32):
    want, deviation, e, trace = plain(rows, components)
    ids = [i for i, _ in rows]
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) * len(e)
    white = np.array([[table[i, k + 1].whitened for k in range(len(e))] for i in ids])
    for k in range(len(e)):
        near = min(np.abs(white[:, k] - s * want[:, k]).max() for s in (1, -1))
        assert near < 1e-7, (k, near)
    for i, d in zip(ids, deviation):
        assert table[i, 1].deviation == d and table[i, 1].n == len(rows)
    for k in range(len(e)):
        assert table[ids[0], k + 1].explained == pytest.approx(e[k] / trace, rel=1e-9)
    assert all(r.identity_error < 1e-6 for r in got)
    assert np.abs(white.T @ white / len(rows) - np.eye(len(e))).max() < 1e-6


def test_equals_plain_eigenvectors(spark, shared):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    check(QUERIES["op13_feast_whitening"](spark, "/root/testdata/sf0.001").collect(), rows)


def test_odd_rows_and_clashing_columns(spark, shared):
    draw = np.random.default_rng(5)
    good = [(k, (draw.standard_normal(6) * [1, 9, 3, 3, 1, 5]).astype(np.float32).tolist()) for k in range(60)]
    odd = [(100, None), (101, [None] * 6), (102, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6),
           (104, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, []), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in good + odd], KINDS)
    check(whitening.whiten(df).collect(), good)
    check(whitening.whiten(df, components=2).collect(), good, 2)
    assert whitening.whiten(df.where("vec_id >= 100 and vec_id < 106")).collect() == []
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []                     # nothing varies
    doubled = df.union(df).where("vec_id < 60")
    assert len({(r.vec_id, r.component, r.deviation) for r in whitening.whiten(doubled).collect()}) == 60 * 6


def test_ties_low_rank_and_huge_entries(spark, shared):
    eye = [(k, [float(s * (j == k // 2)) for j in range(5)]) for k, s in zip(range(10), [1, -1] * 5)]   # equal eigenvalues
    rows = whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in eye], KINDS)).collect()
    white = np.array([[r.whitened for r in sorted(rows, key=lambda r: r.component) if r.vec_id == i] for i, _ in eye])
    assert white.shape == (10, 5) and np.abs(white.T @ white / 10 - np.eye(5)).max() < 1e-9
    flat = [(k, [float(k % 7), 2.0 * (k % 7), 3.0, 0.0]) for k in range(30)]            # rank one
    check(whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in flat], KINDS)).collect(), flat)
    huge = [(k, [3e38 if k else 1.0, float(k)]) for k in range(4)]
    assert len(whitening.whiten(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in huge], KINDS)).collect()) >= 4


def test_inertia_and_intervals(spark, shared):
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 40):
        a = draw.standard_normal((n, n))
        a += a.T
        for s in draw.standard_normal(20) * 3:
            assert whitening.negatives(a - s * np.eye(n)) == (np.linalg.eigvalsh(a) < s).sum()
    assert whitening.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    b = draw.standard_normal((90, 50)) * np.geomspace(1, 1e-3, 50)
    e, u = whitening.eigenpairs(spark, b.T @ b, 32)
    want = np.linalg.eigvalsh(b.T @ b)[::-1][:32]
    assert np.allclose(e, want, rtol=1e-9) and np.abs(u.T @ u - np.eye(32)).max() < 1e-12
