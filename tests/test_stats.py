import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clearwell.functions import correlation, stats
from clearwell.functions.correlation import correlations

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    tail = rng.pareto(0.4, 3000)
    rows = [(float(v), int(v) % 7, None) for v in tail]
    rows += [(0.5, 3, None)] * 2000  # one value fills a good third
    rows += [(None, None, None)] * 20 + [(1e300, 1, None), (-1e300, 2, None)]
    return spark.createDataFrame(rows, "x double, k int, void double").repartition(4)


@pytest.mark.parametrize("limit", [1, 50, 2000, 10**9])
def test_quantiles_are_exact_on_every_path(skewed, limit):
    found = stats.quantiles(skewed, ["x", "k", "void"], PROBABILITIES, sorted_cells=limit)
    for c in ("x", "k"):
        want = skewed.agg(F.percentile(c, F.array(*map(F.lit, PROBABILITIES)))).first()[0]
        assert found[c] == pytest.approx(want, rel=1e-12)
    assert found["void"] == [None] * len(PROBABILITIES)


def test_quantiles_by_sketch(skewed):
    found = stats.quantiles(skewed, ["k"], [0.5], accuracy=1000)
    assert found["k"] == [3.0]


def test_moments_match_pandas(skewed):
    pdf = skewed.where(F.abs("x") < 1e6).toPandas()
    m = stats.moments(skewed.where(F.abs("x") < 1e6), ["x", "void"], shape=True)
    x = m.columns["x"]
    assert (x.n, m.rows) == (len(pdf), len(pdf))
    assert x.variance == pytest.approx(pdf.x.var())
    assert x.skew == pytest.approx(pdf.x.skew())
    assert x.kurtosis == pytest.approx(pdf.x.kurt())
    assert m.columns["void"].n == 0 and m.columns["void"].mean is None


def test_many_columns_in_one_scan(spark):
    df = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(150)])
    found = stats.moments(df, df.columns).columns
    assert found["c149"].mean == 151.0 and found["c0"].mean == 2.0
    counts = stats.value_counts(df, df.columns).groupBy("ordinal").count().collect()
    assert {r["ordinal"]: r["count"] for r in counts} == dict.fromkeys(range(150), 5)


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=400)
    rows = [
        (float(x), float(2 * x + n), None if i % 3 else float(-x + n), 7.0, None if i % 2 else float(n))
        for i, (x, n) in enumerate(zip(a, rng.normal(size=400)))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, e double")
    want = df.toPandas().corr()
    for (x, y), r in correlations(df, df.columns).items():
        if "k" in (x, y):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_value_counts_keep_types(spark):
    df = spark.createDataFrame([(10, 0.0, True), (9, -0.0, None)], "i int, d double, b boolean")
    rows = stats.value_counts(df, df.columns).collect()
    assert {(r["whole"], r["n"]) for r in rows if r["ordinal"] == 0} == {(10, 1), (9, 1)}
    assert [(r["fraction"], r["n"]) for r in rows if r["ordinal"] == 1] == [(0.0, 2)]
    assert {r["text"] for r in rows if r["ordinal"] == 2} == {"true", None}


def test_correlations_with_gaps_shifts_and_infinity(spark, monkeypatch):
    """Products for most pairs, a closer look for those that would lose digits, in several blocks."""
    draw = np.random.default_rng(5)
    base = draw.normal(0, 1, (400, 9))
    base[:, 1] += base[:, 0]
    base[:, 2] = base[:, 0] * 1e-3 + 1e9  # far from zero
    base[:200, 3] += 1e8  # far from its middle on half of the rows
    base[:, 4] = 7.0
    pdf = pd.DataFrame(base, columns=[f"c{i}" for i in range(9)]).mask(draw.random(base.shape) < 0.3)
    pdf.loc[200:, "c5"] = np.nan  # shares the far half only with c3
    pdf.loc[5, ["c6", "c7"]] = [np.inf, 1.0]
    pdf["c8"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()], ", ".join(f"{c} double" for c in pdf.columns))
    want = {}
    for i, a in enumerate(pdf.columns):
        for b in pdf.columns[i + 1 :]:
            both = pdf[[a, b]].dropna().to_numpy()
            fine = len(both) > 1 and np.isfinite(both).all() and (both.min(axis=0) < both.max(axis=0)).all()
            want[a, b] = np.corrcoef(both.T)[0, 1] if fine else None
    for block in (512, 2):
        monkeypatch.setattr(correlation, "BLOCK", block)
        got = correlation.correlations(df.repartition(3), df.columns)
        assert list(got) == list(want)
        for pair, r in want.items():
            assert (got[pair] is None) == (r is None) and (r is None or abs(got[pair] - r) < 1e-6), (pair, got[pair], r)
