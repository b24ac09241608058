import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwell.operators import isolation, outliers


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (950, 2)))]
    rows += [(i, float(9 + a), float(-9 + b)) for i, (a, b) in enumerate(rng.normal(0, 1, (50, 2)), 950)]
    rows.append((1000, None, 1.0))
    return spark.createDataFrame(rows, "id bigint, a double, b double")


def test_planted_outliers_are_found(planted):
    df, summary = isolation.detect_outliers_isolation_forest(
        planted, contamination=0.05, columns=["a", "b"], key=["id"]
    )
    flagged = {r["id"] for r in df.where("is_outlier").collect()}
    assert len(flagged & set(range(950, 1000))) >= 48
    assert 1000 not in flagged
    assert summary["n_anomalies"] == len(flagged) and 0.03 < summary["anomaly_ratio"] <= 0.051


def test_model_scores_other_tables(planted, spark):
    model = isolation.fit_isolation_forest(planted, columns=["a", "b"], key=["id"])
    new = spark.createDataFrame([(0.0, 0.0), (30.0, 30.0), (None, 0.0)], "a double, b double")
    scores = [r["anomaly_score"] for r in model.score(new).collect()]
    assert 0 < scores[0] < model.threshold < scores[1] < 1 and scores[2] is None
    assert [r["is_outlier"] for r in model.transform(new).collect()] == [False, True, False]


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("x",), ("y",)], "a string")
    out, summary = isolation.detect_outliers_isolation_forest(df)
    assert out.where("is_outlier").count() == 0
    assert summary == {"n_anomalies": 0, "anomaly_ratio": 0.0}


def test_removal_keeps_the_columns(planted):
    out = outliers.remove_outliers(planted, "Isolation Forest", columns=["a", "b"], contamination=0.1)
    assert out.columns == planted.columns and 880 <= out.count() <= 925


def test_expected_depth():
    assert list(isolation.expected_depth([1, 2])) == [0.0, 1.0]
    assert isolation.expected_depth(256) == pytest.approx(10.2448, abs=1e-3)


def test_large_splits_are_dealt_anew(planted, monkeypatch):
    """A table of many rows in one split is not scored by one task."""
    used, kept = [], isolation.materialize
    monkeypatch.setattr(isolation, "ROWS_PER_SPLIT", 10)
    monkeypatch.setattr(isolation, "materialize", lambda df, label: used.append(
        df.select(F.spark_partition_id()).distinct().count()) or kept(df, label))
    flagged = isolation.flag_anomalies(planted.coalesce(1), trees=5, key=["id"])
    assert used[0] >= 50 and flagged.count() == 1001
