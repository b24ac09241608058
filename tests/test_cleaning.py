import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwell.operators import (
    columns,
    dedupe,
    encode,
    invalid,
    missing,
    outliers,
    ranges,
    scale,
    text,
)
from clearwell.plans import profile

from .conftest import column


@pytest.mark.parametrize("strategy", missing.STRATEGIES)
def test_no_gaps_left(sample_df, strategy):
    out = missing.handle_missing_values(sample_df, strategy)
    assert profile.basic_metrics(out).first()["missing"] == 0
    assert out.columns == sample_df.columns
    assert (out.count() == 7) == (strategy != "Drop")


def test_mean_and_median(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,), (40.0,), (100.0,)], "x double")
    assert 42.5 in column(missing.handle_missing_values(df, "Mean"), "x")
    assert 30.0 in column(missing.handle_missing_values(df, "Median"), "x")


def test_mode_ties_take_the_smallest_number(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, None)], "n bigint, t string")
    out = missing.handle_missing_values(df, "Mode").collect()
    assert (9, "a") in [tuple(r) for r in out][2:]


def test_all_null_column_stays(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    out = missing.handle_missing_values(df, "Mean")
    assert column(out, "a") == [None, None] and column(out, "b") == [1.0, 1.0]


def test_drop_duplicates_with_map(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 1}), (1, {"a": 2})], "i int, m map<string,int>")
    out = dedupe.drop_duplicates(df)
    assert out.columns == df.columns and out.count() == 2


def test_iqr_flags(spark):
    df = spark.createDataFrame([(v,) for v in (10, 12, 11, 13, 10, 12, 500)], "value bigint")
    flags = {r["value"]: r["is_outlier"] for r in outliers.detect_outliers_iqr(df).collect()}
    assert flags[500] and not flags[10]
    z = {r["value"]: r["is_outlier"] for r in outliers.detect_outliers_zscore(df, 2.0).collect()}
    assert z[500] and not z[10]
    assert outliers.remove_outliers(df, "IQR").count() == 6
    with pytest.raises(ValueError):
        outliers.remove_outliers(df, "Guess")


def test_iqr_null_rules(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5.0), (2.0, None, 5.0), (3.0, None, 5.0), (None, None, None)],
        "a double, void double, same double",
    )
    only_a = df.select("a")
    assert column(outliers.detect_outliers_iqr(only_a), "is_outlier") == [False, False, False, True]
    assert not any(column(outliers.detect_outliers_iqr(only_a, null_is_outlier=False), "is_outlier"))
    assert all(column(outliers.detect_outliers_iqr(df.select("void")), "is_outlier"))
    assert not any(column(outliers.detect_outliers_iqr(df.select("same")), "is_outlier"))
    assert not any(column(outliers.detect_outliers_zscore(df), "is_outlier"))


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in ("NA", "none", "-", "--", "null", "hello", "nan", " na")], "a string")
    assert column(invalid.replace_invalid_values(df), "a") == [None] * 5 + ["hello", None, " na"]


def test_negatives(spark):
    df = spark.createDataFrame([(-1.0, -2), (5.0, 3), (-99.0, None)], "s double, i int")
    out = invalid.replace_invalid_values(df, treat_negative_as_invalid=True)
    assert column(out, "s") == [None, 5.0, None] and column(out, "i") == [None, 3, None]
    out = invalid.replace_invalid_values(df, replace_with=0, treat_negative_as_invalid=True)
    assert column(out, "s") == [0.0, 5.0, 0.0]


def test_text(spark):
    df = spark.createDataFrame([("  HR ", 1), (None, 2), ("\tIT\n", 3)], "t string, n int")
    assert column(text.standardize_text_columns(df), "t") == ["hr", None, "it"]
    assert column(text.standardize_text_columns(df, lowercase=False), "t") == ["HR", None, "IT"]
    assert column(text.standardize_text_columns(df, strip_space=False), "t")[2] == "\tit\n"
    assert column(text.standardize_text_columns(df, ["n", "absent"]), "n") == ["1", "2", "3"]


def test_categories(spark):
    df = spark.createDataFrame([("hr",), (" HR ",), ("Hr",), ("Finance",), (None,)], "dept string")
    out = text.standardize_categories(df, "dept", {"hr": "Human Resources", "HR": "Other"})
    assert column(out, "dept") == ["Human Resources"] * 3 + ["Finance", None]
    assert text.standardize_categories(df, "absent", {"a": "b"}) is df


def test_range(spark):
    df = spark.createDataFrame([(-5.0, "-5"), (25.0, "x"), (150.0, "150"), (None, None)], "age double, t string")
    assert column(ranges.validate_range(df, "age", 0, 100), "age") == [0.0, 25.0, 100.0, None]
    assert column(ranges.validate_range(df, "age", 0, 100, "nan"), "age") == [None, 25.0, None, None]
    assert column(ranges.validate_range(df, "t", 0, 100), "t") == [0.0, None, 100.0, None]
    assert ranges.validate_range(df, "absent", 0, 1) is df


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), 10.0 * i, 0.1) for i in range(1, 6)], "x double, y double, same double")
    out = scale.scale_numeric(df, "Min-Max")
    assert column(out, "x_scaled") == [0.0, 0.25, 0.5, 0.75, 1.0] and "same_scaled" not in out.columns
    again = scale.scale_numeric(out, "Min-Max")
    assert again.columns == out.columns
    std = np.array(column(scale.scale_numeric(df, "Standard"), "y_std"))
    assert std.mean() == pytest.approx(0, abs=1e-12) and std.std() == pytest.approx(1)
    assert "same_std" not in scale.scale_numeric(df, "Standard").columns


def test_label_codes(spark):
    df = spark.createDataFrame([(c,) for c in ("red", "Blue", None, "red", "Z")], "color string")
    out = {r["color"]: r["color_encoded"] for r in encode.label_encode(df, "color").collect()}
    assert out == {"Blue": 0, None: 1, "Z": 2, "red": 3}
    old = {r[0]: r[1] for r in encode.label_encode(df, "color", missing_label="nan").collect()}
    assert old == {"Blue": 0, "Z": 1, None: 2, "red": 3}


def test_codes_without_broadcast(spark):
    """Range-partitioned numbering and the salted join give the same codes."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 400)).alias("t")
    )
    small = encode.label_encode(df, "t").orderBy("id").collect()
    large = encode.label_encode(df, "t", broadcast_rows=0, single_task_rows=50).orderBy("id").collect()
    assert small == large
    first = encode.factorize(df, "t", "id").orderBy("id").collect()
    assert first == encode.factorize(df, "t", "id", broadcast_rows=0, single_task_rows=50).orderBy("id").collect()
    assert [r["t_encoded"] for r in first[:4]] == [0, 1, 2, 0]


def test_factorize_null_and_order(spark):
    df = spark.createDataFrame([(3, 5.0), (1, 7.0), (2, None), (4, 7.0)], "k int, v double")
    assert {r["k"]: r["v_encoded"] for r in encode.factorize(df, "v", "k").collect()} == {1: 0, 2: -1, 3: 1, 4: 0}
    with pytest.raises(ValueError):
        encode.factorize(df, "v")


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "red"), (2, "blue"), (3, None)], "`k.1` int, `c d.e` string")
    assert {r["k.1"]: r["c d.e_encoded"] for r in encode.label_encode(df, "c d.e").collect()} == {1: 2, 2: 1, 3: 0}
    assert {r["k.1"]: r["c d.e_encoded"] for r in encode.factorize(df, "c d.e", "k.1").collect()} == {1: 0, 2: 1, 3: -1}
    assert {r["k.1"]: r["k.1_encoded"] for r in columns.apply_column_operation(df, "Encode categorical", "k.1", order_by="k.1").collect()} == {1: 0, 2: 1, 3: 2}


def test_codes_of_another_table(spark):
    train = spark.createDataFrame([(1, "red"), (2, "blue"), (3, None), (4, "red")], "k int, c string")
    other = spark.createDataFrame([(1, "blue"), (2, "green"), (3, None), (4, "green"), (5, "red")], "k int, c string")
    label, order, hot = encode.fit_label(train, "c"), encode.fit_factorize(train, "c", "k"), encode.fit_one_hot(train, "c")
    for rows in (200_000, 0):  # broadcast or shuffled
        label.broadcast_rows = order.broadcast_rows = rows
        assert {r.k: r.c_encoded for r in label.transform(other).collect()} == {1: 1, 2: None, 3: 0, 4: None, 5: 2}
        assert {r.k: r.c_encoded for r in order.transform(other).collect()} == {1: 1, 2: None, 3: -1, 4: None, 5: 0}
    assert sorted(map(tuple, hot.transform(other).collect())) == [
        (1, True, False), (2, False, False), (3, False, False), (4, False, False), (5, False, True)]
    for model in (label, order, hot):
        assert list(map(tuple, model.unseen(other).collect())) == [("green", 2)] and model.unseen(train).isEmpty()
    empty = encode.fit_one_hot(train.limit(0), "c")
    assert empty.transform(other).columns == ["k"] and empty.unseen(other).count() == 3


def test_one_hot(spark):
    df = spark.createDataFrame([("red", 1), ("blue", 2), (None, 3)], "color string, n int")
    out = encode.encode_categorical(df, "color", "One-Hot")
    assert out.columns == ["n", "color_blue", "color_red"]
    assert [tuple(r) for r in out.collect()] == [(1, False, True), (2, True, False), (3, False, False)]
    assert encode.encode_categorical(df, "absent") is df
    # Beyond the caller's number of columns nothing is refused: one map column.
    sparse = encode.one_hot_encode(df, "color", max_columns=1)
    assert [(r["n"], sorted(r["color_one_hot"])) for r in sparse.collect()] == [(1, ["red"]), (2, ["blue"]), (3, [])]


def test_column_operations(full_df):
    apply = columns.apply_column_operation
    assert "num_one" in apply(full_df, "Rename column", "num1", new_name="num_one").columns
    assert apply(full_df, "Rename column", "num1", new_name="num2").columns == full_df.columns
    typed = apply(full_df, "Change datatype", "date_col", target_type="datetime")
    assert typed.schema["date_col"].dataType.simpleString() == "timestamp_ntz"
    assert "num2" not in apply(full_df, "Drop column", "num2").columns
    assert apply(full_df, "Drop column", "absent") is full_df
    assert "cat_encoded" in apply(full_df, "Encode categorical", "cat").columns
    assert "num1_encoded" in apply(full_df, "Encode categorical", "num1", order_by="num2").columns


def test_casts(spark):
    rows = [("12",), ("12.7",), ("5d",), (" 8 ",), ("1e3",), ("9007199254740993",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert column(columns.change_type(df, "t", "int"), "t") == [12, None, None, 8, 1000, 9007199254740993, None]
    assert column(columns.change_type(df, "t", "float"), "t")[:5] == [12.0, 12.7, None, 8.0, 1000.0]
    assert column(columns.change_type(df, "t", "string", missing_text="nan"), "t")[-1] == "nan"
    dates = spark.createDataFrame([("2024-02-03",), ("02/03/2024",), ("soon",)], "d string")
    days = [str(d)[:10] for d in column(columns.change_type(dates, "d", "datetime"), "d")]
    assert days == ["2024-02-03", "2024-02-03", "None"]


def test_clean_names(spark):
    df = spark.range(1).toDF(" A B/C-D")
    assert columns.clean_column_names(df).columns == ["a_b_c_d"]
    with pytest.raises(ValueError, match="a_b"):
        columns.clean_column_names(spark.range(1).select(F.lit(1).alias("a b"), F.lit(2).alias("A-B")))


def test_preview(full_df):
    assert column(columns.preview(full_df, ["num2"], 2), "num2") == [None, 10.0]
    assert columns.preview(full_df, ["num2"], 2, max_columns=3).columns == ["num1", "num2", "cat"]
