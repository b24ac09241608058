import math
import random

import numpy as np
import pytest

from clearwell.llm.whitening import components, polar, whiten


def plain(rows, wanted=8):
    """[(id, deviation, whitened up to sign)], explained."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) + 100000 for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([v + [100000] * (width - len(v)) for _, v in kept], np.int64)
    n, total = len(x), x.sum(axis=0)
    away = n * x - total
    centred = away / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:wanted]
    order = order[values[order] > 1e-9 * max(1e-300, abs(values).max())]
    return [i for i, _ in kept], (away**2).sum(axis=1).tolist(), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id bigint, embedding array<float>, id int, v string, whitened int")


def compare(spark, rows, wanted=8):
    done, model = whiten(frame(spark, rows), wanted=wanted)
    got = sorted(done.collect(), key=lambda r: (r.deviation, repr(r["id"])))
    ids, away, white, explained = plain(rows, wanted)
    order = sorted(range(len(ids)), key=lambda i: (away[i], repr(ids[i])))
    assert [(r["id"], r.deviation) for r in got] == [(ids[i], away[i]) for i in order]
    w = np.array([r.whitened for r in got])
    white = white[order]
    signs = np.sign((w * white).sum(axis=0))
    assert np.abs(w * signs - white).max() < 1e-9
    assert np.allclose(model["explained"], explained, rtol=1e-10) and model["identity_error"] < 1e-9
    assert model["n"] == len(ids)


def test_equals_dense_eigenvectors(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(0, 0.2, (600, 24)) @ np.diag(np.linspace(1, 3, 24)) + 5
    compare(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    compare(spark, [(i, v.tolist()) for i, v in enumerate(vectors[:, :3])])


def test_awkward_rows(spark):
    draw = random.Random(2)
    fine = lambda n=5: [draw.uniform(-1, 1) for _ in range(n)]
    same = fine()
    rows = [(0, fine()), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf")]), (500, []),
            (None, fine()), (700, same), (700, same), (1, fine(2)), (2, None), (-100, fine()), (5, fine()), (6, fine())]
    compare(spark, rows)
    compare(spark, rows, wanted=2)


def test_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        done, model = whiten(frame(spark, rows))
        assert done.count() == len([r for r in rows if r[1] == []]) and len(model["values"]) == 0
    done, model = whiten(frame(spark, [(1, [0.5, 0.25])] * 3))
    assert [(r["id"], r.deviation, r.whitened) for r in done.collect()] == [(1, 0, [])] * 3 and model["identity_error"] == 0.0
    # Rank 1: one component only.
    done, model = whiten(frame(spark, [(i, [0.5 * i, 0.5 * i]) for i in range(9)]))
    assert all(len(r.whitened) == 1 for r in done.collect()) and model["identity_error"] < 1e-12


def test_very_large_components(spark):
    rows = [(i, [3e30 * (i + 1), 1.0 * i]) for i in range(4)]
    done, _ = whiten(frame(spark, rows))
    assert done.count() == 4 and all(r.deviation >= 0 for r in done.collect())


@pytest.mark.parametrize("values", [
    np.linspace(0, 1, 40), np.ones(12), np.r_[np.ones(3) * 5, np.ones(20)], np.r_[10, 9, 8, np.zeros(30)],
    np.r_[1e8, np.linspace(0, 1, 30)], 2.0 ** -np.arange(30), np.array([3.0]), np.zeros(5), np.r_[1, -1, 0, 0.5]])
def test_components_of_given_spectra(values):
    draw = np.random.default_rng(3)
    q = np.linalg.qr(draw.standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    found, vectors = components(a)
    size = max(1e-300, np.abs(values).max())
    assert np.abs(found - np.sort(values)[::-1][:8]).max() <= 1e-13 * size
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-13
    assert np.abs(vectors @ a - found[:, None] * vectors).max() <= 1e-13 * size


def test_polar_factor_is_orthogonal_even_when_nearly_singular():
    draw = np.random.default_rng(4)
    q = np.linalg.qr(draw.standard_normal((20, 20)))[0]
    values = np.r_[np.linspace(-1, 1, 18), 1e-9, -1e-9]
    u = polar(q @ np.diag(values) @ q.T)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-12
    assert np.abs(u - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-6
