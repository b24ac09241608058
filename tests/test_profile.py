import pandas as pd
import pytest

from clearwell.plans import profile


def test_basic_metrics(sample_df):
    assert profile.basic_metrics(sample_df).first().asDict() == {
        "rows": 7, "cols": 4, "missing": 4, "duplicates": 2,
    }


def test_copies_and_nulls_count_as_equal(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (1,), (None,), (None,)], "a bigint")
    assert profile.basic_metrics(df).first()["duplicates"] == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    assert profile.basic_metrics(df).first().asDict() == {
        "rows": 0, "cols": 2, "missing": 0, "duplicates": 0,
    }
    assert profile.quality_score(df).first()["score"] == 0.0
    summary = profile.dtype_summary(df).collect()
    assert [(r["Column"], r["Unique Values"]) for r in summary] == [("a", 0), ("b", 0)]


def test_score_of_clean_table(clean_df):
    assert profile.quality_score(clean_df).first()["score"] == 100.0


def test_score_range_and_order(sample_df, clean_df):
    untidy = profile.quality_score(sample_df).first()["score"]
    assert 0.0 <= untidy < profile.quality_score(clean_df).first()["score"]


def test_score_of_missing_table(spark):
    df = spark.createDataFrame([(None, None)] * 3, "a string, b string")
    assert profile.quality_score(df).first()["score"] < 60


def test_long_text_and_map_columns(spark):
    long = "x" * 500
    df = spark.createDataFrame(
        [(long + "a", {"k": 1}), (long + "b", {"k": 1}), (long + "a", {"k": 1})],
        "t string, m map<string,int>",
    )
    assert profile.basic_metrics(df).first()["duplicates"] == 1
    found = {r["Column"]: r["Unique Values"] for r in profile.dtype_summary(df).collect()}
    assert found == {"t": 2, "m": 1}


def test_dtype_summary(sample_df):
    rows = {r["Column"]: r for r in profile.dtype_summary(sample_df).collect()}
    assert list(rows) == ["age", "salary", "dept", "score"]
    assert rows["age"]["Missing Count"] == 1
    assert rows["age"]["Missing %"] == 14.29
    assert rows["dept"]["Unique Values"] == 3
    approx = profile.dtype_summary(sample_df, approx=True).collect()
    assert [tuple(r) for r in approx] == [tuple(r) for r in rows.values()]


def test_numeric_summary_matches_pandas(sample_df):
    pdf = sample_df.toPandas()
    for row in profile.numeric_summary(sample_df).collect():
        s = pdf[row["Column"]]
        want = [*s.describe(), s.skew(), s.kurt()]
        assert list(row)[1:] == pytest.approx(want, abs=1e-4)


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, None), (5.0, None)], "a double, b double")
    rows = {r["Column"]: r for r in profile.numeric_summary(df).collect()}
    assert (rows["a"]["skewness"], rows["a"]["kurtosis"]) == (0.0, 0.0)
    assert (rows["b"]["skewness"], rows["b"]["kurtosis"]) == (None, None)


def test_feature_types(spark):
    df = spark.createDataFrame(
        [(i, f"t{i}", "ab"[i % 2], pd.Timestamp("2024-01-01").to_pydatetime()) for i in range(60)],
        "n bigint, t string, c string, d timestamp_ntz",
    )
    kinds = {r["Column"]: r["Inferred Type"] for r in profile.detect_feature_types(df).collect()}
    assert kinds == {"n": "Numeric", "t": "Text", "c": "Categorical", "d": "Date"}


def test_report_schema_limits(spark):
    df = spark.range(2).selectExpr(*[f"id as {'c' * 40}{i}" for i in range(25)])
    rows = profile.report_schema(df).collect()
    assert len(rows) == 20 and len(rows[0]["Column"]) == 30
    assert rows[0]["Missing %"] == "0.0%"


def test_profile_text(full_df, spark):
    text = profile.profile_text(full_df).first()["profile"]
    assert text.startswith("Dataset shape: 6 rows x 4 columns\n\nColumn details:\n  - 'num1'")
    assert "has_negatives=True" in text and text.endswith("\nDuplicate rows: 0")
    short = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert "skewness" not in profile.profile_text(short).first()["profile"]
    assert "skewness=0.00" in profile.profile_text(short, full=True).first()["profile"]


def test_quality_band(spark):
    df = spark.createDataFrame([(39.9,), (40.0,), (70.0,)], "s double")
    assert [r[0] for r in df.select(profile.quality_band(df.s)).collect()] == ["poor", "fair", "good"]
