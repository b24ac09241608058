import math
import random

import numpy as np

from clearwell.llm import topk


def plain(rows, queries, k):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(np.float32(x))) for x in v]

    fine = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    asked = {}
    for i, v in queries:
        if i is not None and ints(v) is not None:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(ints(v), w)), i) for i, w in fine if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id int, v string")


def run(spark, rows, k=10):
    df = frame(spark, rows)
    return sorted(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0"), k).collect()))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "ROUND_BYTES", 3 * 25 * 8)  # three queries a round
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 1, (8, 24))
    vectors = centres[draw.integers(0, 8, 900)] + draw.normal(0, 0.3, (900, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)]  # ties
    assert run(spark, rows) == plain(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_awkward_rows(spark):
    draw = random.Random(2)
    fine = lambda: [draw.uniform(-1, 1) for _ in range(5)]
    rows = [(0, fine()), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf")]), (500, []), (600, [0.5, 0.25]),
            (None, fine()), (700, fine()), (700, fine()), (1, fine()), (1, fine()), (2, None), (3, [0.0] * 9), (-100, fine())]
    assert run(spark, rows) == plain(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)


def test_very_large_components_are_exact(spark):
    rows = [(0, [3e5, 1.0]), (1, [2e5, 0.5]), (2, [2e5, -0.5]), (3, [-9e5, 1.0])]
    assert run(spark, rows) == plain(rows, rows[:1], 10)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(0, [1.0])]) == []


def test_segments_hold_every_row_once_and_need_fewer_products():
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 200, (20, 32))
    vectors = np.floor(centres[draw.integers(0, 20, 1500)] + draw.normal(0, 60, (1500, 32)))
    index = topk.ImpactIndex.build(vectors)
    # The segments add up to the quantised block, and what is left is as long as said.
    seen = np.zeros_like(vectors)
    for s in range(len(index.dims)):
        rows = index.rows[index.ends[s - 1] if s else 0 : index.ends[s]]
        assert len(set(rows.tolist())) == len(rows) and (seen[rows, index.dims[s]] == 0).all()
        seen[rows, index.dims[s]] = index.impacts[s]
    step = np.abs(index.impacts).min()
    assert (np.abs(vectors - seen) <= np.maximum(step, np.abs(vectors) - topk.LEVELS * step)).all()
    assert np.allclose(index.rests[-1], np.sqrt(((vectors - seen) ** 2).sum(axis=1)))
    assert (np.diff(np.abs(index.impacts)) <= 0).all() and index.levels[-1] == len(index.dims)
    queries, ids = vectors[::100], np.arange(1500)
    found = {}
    for q, rows, scores in index.search(vectors, queries, ids[::100], ids, 10, np.full(15, -np.inf)):
        found[q] = sorted(zip((-scores).tolist(), rows.tolist()))[:10]
    for q in range(15):
        scores = vectors @ queries[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != 100 * q)[:10]
        assert found[q] == want
    assert index.multiplied < 0.6 * len(queries) * vectors.size


def test_a_bar_drops_rows_below_it():
    draw = np.random.default_rng(5)
    vectors = np.floor(draw.normal(0, 300, (400, 16)))
    queries, ids = vectors[:3], np.arange(400)
    index = topk.ImpactIndex.build(vectors)
    bar = np.sort(vectors @ queries.T, axis=0)[-4]  # three others are above it, or the query itself and two
    got = {q: {r for r, s in zip(rows.tolist(), scores.tolist()) if s > bar[q]} for q, rows, scores in
           index.search(vectors, queries, np.array([-1, -2, -3]), ids, 10, bar)}
    assert all(len(got[q]) == 3 for q in range(3))
