"""Cases in which figures, ties or types once went wrong."""

import decimal

import pytest
from pyspark.sql import functions as F

from clearwell.functions.correlation import correlations
from clearwell.functions.exprs import significant
from clearwell.operators import encode, missing, outliers, scale
from clearwell.operators.columns import change_type
from clearwell.plans import insights, profile, suggest
from clearwell.sources.reader import load_dataset


def test_a_far_value_without_partner_does_not_blur_a_pair(spark):
    rows = [(float(x), 2.0 * x) for x in range(1, 101)] + [(1e12, None)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(7)
    assert correlations(df, ["x", "y"])["x", "y"] == pytest.approx(1.0, abs=1e-12)


def test_correlations_of_constant_empty_and_nan_columns(spark):
    rows = [(1.0, 5.0, None, float("nan")), (2.0, 5.0, None, 3.0), (4.0, 5.0, None, 9.0), (3.0, 5.0, None, 7.0)]
    got = correlations(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd"))
    assert got["a", "d"] == pytest.approx(0.9819805, abs=1e-6)
    assert [got[p] for p in (("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"))] == [None] * 5
    assert correlations(spark.createDataFrame([], "a double, b double"), ["a", "b"]) == {("a", "b"): None}


def test_ties_of_long_texts_go_by_text(spark):
    long = ["z" * 70, "y" * 300 + "b", "y" * 300 + "a"]
    rows = [(t,) for t in ["y", "y", *long, *long]] + [("x" * 600,)]
    told = insights.category_insights(spark.createDataFrame(rows, "c string")).first()["description"]
    assert "`y`" in told
    told = insights.category_insights(spark.createDataFrame([(t,) for t in long * 2], "c string")).first()["description"]
    assert f"`{'y' * 300}a`" in told


def test_decimal_ties_compare_as_numbers(spark):
    rows = [(decimal.Decimal(x),) for x in ("10.00", "10.00", "9.00", "9.00")] + [(None,)]
    df = spark.createDataFrame(rows, "d decimal(12,2)")
    assert missing.most_frequent(df, ["d"]) == {"d": decimal.Decimal("9.00")}


def test_large_keys_are_not_constant_and_truth_values_are_skewed(spark):
    rows = [((1 << 60) + i % 3, i == 0) for i in range(21)]
    df = spark.createDataFrame(rows, "k bigint, b boolean")
    told = {(r["Column"], r["Issue Detected"]) for r in suggest.rule_based_suggestions(df).collect()}
    assert ("b", "Skewed (4.58)") in told and not any(c == "k" and i.startswith("Constant") for c, i in told)
    basic = {(r["Column"], r["Issue Detected"]) for r in suggest.rule_based_suggestions(df, rules="basic").collect()}
    assert ("b", "Numeric with low cardinality") in basic
    assert {r["Column"]: r["Inferred Type"] for r in profile.detect_feature_types(df).collect()} == {"k": "Numeric", "b": "Numeric"}
    assert "skewness=4.58, has_negatives=False" in profile.profile_text(df).first()[0]


def test_nan_is_missing_for_every_fit(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    metrics = profile.basic_metrics(df).first()
    assert (metrics["rows"], metrics["missing"], metrics["duplicates"]) == (4, 2, 1)
    for strategy in ("Mean", "Median"):
        assert sorted(r.x for r in missing.handle_missing_values(df, strategy).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r.x for r in missing.handle_missing_values(df, "Mode").collect()) == [1.0, 1.0, 1.0, 3.0]
    scaled = scale.fit_scale(df, "Min-Max")
    assert scaled.shifts == {"x": (1.0, 2.0)}
    assert outliers.detect_outliers_zscore(df, 3.0).where("is_outlier").count() == 0


def test_names_of_categories_stay_apart(spark):
    df = spark.createDataFrame([("HR",), ("hr",), ("Hr",), (None,)], "d string").withColumn("D_HR", F.lit(1))
    out = encode.one_hot_encode(df, "d")
    assert out.columns == ["D_HR", "d_HR_2", "d_Hr_3", "d_hr_4"] and out.select(*[f"`{c}`" for c in out.columns]).count() == 4
    wide = encode.one_hot_encode(df, "d", max_columns=2)
    assert [sorted(r["d_one_hot"]) for r in wide.collect()] == [["HR"], ["hr"], ["Hr"], []]


@pytest.mark.parametrize("text, want", [
    ("1/5/2024", "2024-01-05 00:00:00"), ("01/05/2024 13:45", "2024-01-05 13:45:00"), ("Jan 5, 2024", "2024-01-05 00:00:00"),
    ("5 January 2024", "2024-01-05 00:00:00"), ("05.01.2024", "2024-01-05 00:00:00"), ("2024/1/5", "2024-01-05 00:00:00"),
    ("5-JAN-2024", "2024-01-05 00:00:00"), ("1/5/2024 12:05 AM", "2024-01-05 00:05:00"), ("2024-03-10 02:30:00", "2024-03-10 02:30:00"),
    ("2024-02-30", None), ("1/5/2024 25:00", None), ("13:45", None), ("", None), (None, None), ("May 2024", "2024-05-01 00:00:00"),
    ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), ("2024-01-05 10:00:00+02:00", "2024-01-05 10:00:00"),
    ("13/01/2024", "2024-01-13 00:00:00"), ("01/05/24", "2024-01-05 00:00:00"), ("5-Jan-24", "2024-01-05 00:00:00"),
    ("Sept 5, 2024", "2024-09-05 00:00:00"), ("Fri, 05 Jan 2024", "2024-01-05 00:00:00"), ("2024-01", "2024-01-01 00:00:00"),
    ("2024", "2024-01-01 00:00:00"), ("2024-01-05T10:00:00.123+0530", "2024-01-05 10:00:00.123"), ("20240105T101112", "2024-01-05 10:11:12"),
    ("Fri Jan  5 10:00:00 2024", "2024-01-05 10:00:00"), ("05Jan2024", "2024-01-05 00:00:00"), ("2024 Jan 5", "2024-01-05 00:00:00"),
    ("5th of January 2024", "2024-01-05 00:00:00"), ("2024Q2", "2024-04-01 00:00:00"), ("12/31/99", "1999-12-31 00:00:00"),
    ("5/6/68", "2068-05-06 00:00:00"), ("13-13-2024", None), ("32/01/2024", None), ("1704448800", None), ("5 Jan", None),
])
def test_forms_of_dates(spark, text, want):
    df = change_type(spark.createDataFrame([(text,)], "t string"), "t", "datetime")
    assert df.select(F.col("t").cast("string")).first()[0] == want


def test_layout_of_a_date_column(spark):
    def read(*cells):
        df = spark.createDataFrame([(c,) for c in cells], "`d.t` string")
        return [str(r[0]) for r in change_type(df, "d.t", "datetime").collect()]

    # The day first where that reads more cells, month first in a tie; each separator by itself.
    assert read("01/02/2024", "13/02/2024", "14/02/2024", "02/15/2024") == [
        "2024-02-01 00:00:00", "2024-02-13 00:00:00", "2024-02-14 00:00:00", "2024-02-15 00:00:00"]
    assert read("01/02/2024", "13/02/2024", "02/13/2024")[0] == "2024-01-02 00:00:00"
    assert read("01/02/24", "02/13/24", "03-04-24", "13-04-24") == [
        "2024-01-02 00:00:00", "2024-02-13 00:00:00", "2024-04-03 00:00:00", "2024-04-13 00:00:00"]
    # One zone: the clock; several: UTC.
    assert read("2024-01-05 10:00+02:00", "2024-01-05 11:00+02:00", "x") == ["2024-01-05 10:00:00", "2024-01-05 11:00:00", "None"]
    assert read("2024-01-05 10:00+02:00", "2024-01-05 10:00Z", "2024-01-05 01:30-0430", "2024-01-05") == [
        "2024-01-05 08:00:00", "2024-01-05 10:00:00", "2024-01-05 06:00:00", "2024-01-05 00:00:00"]
    assert read() == [] and read(None, "") == ["None", "None"]


def regexes(df):
    """How often a regular expression stands in the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(plan.lower().count(word) for word in ("regexp_extract", "regexp_replace", "rlike"))


def test_a_date_is_read_once_a_cell_with_the_day_first(spark):
    """Each part of a date is worked out once: written out again for each of its uses, the expression had
    thousands of regular expressions and its code did not compile."""
    df = spark.createDataFrame([("13/02/2024 10:00",), ("01/02/2024 11:30 pm",)], "t string")
    out = change_type(df, "t", "datetime")
    assert regexes(out) < 100
    assert [str(r.t) for r in out.collect()] == ["2024-02-13 10:00:00", "2024-02-01 23:30:00"]


def test_csv_with_line_breaks_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"q ""z"""\n')
    df, _ = load_dataset(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, 'q "z"')]
    (tmp_path / "b.csv").write_text("a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="1 rows have more cells"):
        load_dataset(spark, str(tmp_path / "b.csv"))
    df, info = load_dataset(spark, str(tmp_path / "b.csv"), surplus="report")
    assert sorted(map(tuple, df.collect()), key=repr) == [(1, 2), (3, 4), (6, None)] and info.first()["surplus_rows"] == 1


def test_a_severity_that_is_no_text_voids_the_reply(spark):
    item = '{"Column":"a","Issue Detected":"x","Suggestion":"y","Severity":%s}'
    rows = [(1, f"[{item % '1'},{item % chr(34) + 'high' + chr(34)}]"), (2, "[" + item % '" high "' + "]"), (3, "[" + item % "null" + "]")]
    found = suggest.parse_replies(spark.createDataFrame(rows, "id int, reply string"), "reply", ["id"]).collect()
    assert [(r["id"], r["Severity"]) for r in found] == [(2, "High")]


def test_significant_digits(spark):
    values = [0.0, -1.0, 10.0, 99999.4, 1e6, 1e-5, 0.000125, 123456.0, 2.5, -0.001, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", significant(F.col("x"), 4).alias("t"))
    assert [r.t for r in df.collect()] == [None if v is None else f"{v:.4g}" for v in values]


def test_tables_of_a_scratch_block_are_removed(spark):
    import glob

    from clearwell.functions.storage import materialize, scratch, settled, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    grouped = spark.range(9).groupBy((F.col("id") % 4).alias("g")).count()
    with scratch(spark):
        table = materialize(spark.range(5), "block")
        assert table.count() == 5 and settled(grouped, "block").count() == 4
        assert len(set(glob.glob(f"{folder}/*")) - before) == 2
    assert set(glob.glob(f"{folder}/*")) == before
    plain = spark.range(3)
    assert settled(plain, "block") is plain


def test_categories_from_a_table(spark):
    from clearwell.operators.text import standardize_categories

    df = spark.createDataFrame([("hr ", 1), ("HR", 2), ("it", 3), (None, 4)], "d string, target int")
    mapping = spark.createDataFrame([(" Hr", "People"), ("hr", "Staff"), (None, "x")], "source string, target string")
    assert sorted(map(tuple, standardize_categories(df, "d", mapping).collect()), key=repr) == [
        ("People", 1), ("People", 2), ("it", 3), (None, 4)]


def test_a_date_is_read_once_a_cell_with_zones(spark):
    df = spark.createDataFrame([("2024-01-05 10:00+02:00",), ("Fri, 5 Jan 2024 10:00:00Z",)], "t string")
    out = change_type(df, "t", "datetime")
    assert regexes(out) < 100
    assert [str(r.t) for r in out.collect()] == ["2024-01-05 08:00:00", "2024-01-05 10:00:00"]


def test_dates_of_one_split_are_dealt_out(spark, monkeypatch):
    """A file of many rows was read by one task, so the time grew with the file, whatever the cores."""
    from clearwell.functions import dates

    monkeypatch.setattr(dates, "ROWS_PER_SPLIT", 10)
    days = spark.range(0, 95, 1, 1).select(
        "id", F.concat(F.lit("2024-01-05 10:00+0"), F.col("id") % 3, F.lit(":00")).alias("t"), F.lit("13/02/2024").alias("d"))
    out = change_type(change_type(days, "t", "datetime"), "d", "datetime")
    splits = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(splits) == 95 and max(splits) <= 20
    assert {r.id: (str(r.t), str(r.d)) for r in out.collect()} == {
        i: (f"2024-01-05 {10 - i % 3:02}:00:00", "2024-02-13 00:00:00") for i in range(95)}
    few = days.limit(20)
    assert dates.dealt(few) is few and dates.dealt(days.limit(0)).count() == 0
