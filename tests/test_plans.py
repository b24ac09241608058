import pytest
from pyspark.sql import functions as F

from clearwell.operators import missing
from clearwell.plans import chartdata, compare, insights, suggest
from clearwell.plans.session import CleaningSession

from .conftest import column


# -- suggestions --------------------------------------------------------------


def test_rules_on_untidy_table(sample_df):
    rows = suggest.rule_based_suggestions(sample_df).collect()
    assert rows[0]["Issue Detected"] == "Duplicates (2)" and rows[0]["Severity"] == "High"
    found = [(r["Column"], r["Issue Detected"]) for r in rows]
    assert ("age", "Missing (14.3%)") in found and ("salary", "Outliers (14.3%)") in found
    assert {r["Severity"] for r in rows} <= set(suggest.SEVERITIES)


def test_rules_on_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 1.5, "c", True, None) for i in range(20)],
                               "id bigint, k double, t string, b boolean, void string")
    found = {(r["Column"], r["Issue Detected"]) for r in suggest.rule_based_suggestions(df).collect()}
    assert {("k", "Constant values"), ("t", "Constant values"), ("b", "Constant values"),
            ("void", "High missing (100.0%)")} == found


def test_clean_table_gets_an_info_row(spark):
    wide = spark.range(100).select(
        "id", (F.col("id") * 1.1).alias("value"), F.concat(F.lit("cat_"), F.col("id") % 20).alias("label")
    )
    for rules in ("basic", "current"):
        rows = suggest.rule_based_suggestions(wide, rules).collect()
        assert [r["Severity"] for r in rows] == ["Info"]


def test_source_labels(sample_df, spark):
    ruled = suggest.generate_suggestions(sample_df)
    assert set(column(ruled, "Source")) == {suggest.RULE_SOURCE}
    reply = spark.createDataFrame([(0, "age", "Outliers", "Cap", "High")], suggest.SCHEMA)
    assert column(suggest.generate_suggestions(sample_df, reply), "Source") == [suggest.MODEL_SOURCE]
    empty = suggest.generate_suggestions(sample_df.limit(0))
    assert empty.columns == list(suggest.FIELDS) and empty.count() == 0


def test_replies(spark):
    good = '{"Column":"a","Issue Detected":"x","Suggestion":"y","Severity":" hIGH "}'
    odd = good.replace(" hIGH ", "very bad")
    cases = [
        (1, f"Sure: [{good}] done"), (2, f"[{good}, 5, \"t\", {{\"Column\":\"b\"}}, {odd}]"),
        (3, "no array"), (4, f"[{good}"), (5, f"[{good}] and [1]"), (6, "[]"), (7, None),
    ]
    df = spark.createDataFrame(cases, "id int, reply string")
    rows = suggest.parse_replies(df, "reply", ["id"]).orderBy("id", "position").collect()
    assert [(r["id"], r["position"], r["Severity"]) for r in rows] == [
        (1, 0, "High"), (2, 0, "High"), (2, 4, "Medium"),
    ]


# -- automatic cleaning ----------------------------------------------------------


def test_baseline_steps(sample_df):
    out, steps, source = suggest.auto_clean(sample_df)
    assert source == suggest.RULE_RUN and steps[1] == "Dropped 2 duplicate rows"
    assert steps[0].startswith("Missing values imputed")
    assert out.count() <= 5


def test_baseline_on_clean_table(clean_df):
    out, steps, _ = suggest.auto_clean(clean_df)
    assert steps == ["No issues found — dataset was already clean"] and out.count() == 5


def advice(spark, df, *rows):
    reply = spark.createDataFrame([(i, *r, "High") for i, r in enumerate(rows)], suggest.SCHEMA)
    return suggest.auto_clean(df, suggest.generate_suggestions(df, reply))


def test_guided_steps(full_df, spark):
    out, steps, source = advice(
        spark, full_df,
        ("num1", "Negative values", "Impute mode"), ("num2", "Gaps", "Use median"),
        ("cat", "Messy", "Trim, then label encode"), ("num1", "Range", "Normalize"),
    )
    assert source == suggest.MODEL_RUN
    assert steps == [
        "Replaced invalid/negative numeric values with missing",
        "Imputed missing values using Median",
        "Standardized text in: cat",
        "Applied label encoding on: cat",
        "Scaled numeric columns (Standard): 3 generated",
    ]
    assert out.columns[-3:] == ["num1_std", "num2_std", "cat_encoded_std"]


def test_first_strategy_sticks_except_median(full_df, spark):
    _, steps, _ = advice(spark, full_df, ("num1", "Moderate gaps", "Fill"), ("num2", "Gaps", "Impute mean"))
    assert steps == ["Imputed missing values using Mode"]  # "Moderate" holds "mode"


def test_vague_advice_falls_back(full_df, spark):
    _, steps, source = advice(spark, full_df, ("num1", "Hmm", "Look again"))
    assert source == suggest.MODEL_RUN and all(s.startswith("Fallback: ") for s in steps)


# -- comparison -------------------------------------------------------------------


def test_comparison(sample_df, clean_df):
    rows = compare.before_after(sample_df, clean_df).collect()
    assert [tuple(r) for r in rows] == [
        ("Rows", 7.0, 5.0), ("Columns", 4.0, 4.0), ("Missing Values", 4.0, 0.0),
        ("Duplicate Rows", 2.0, 0.0), ("Missing % of Cells", 14.29, 0.0), ("Duplicate % of Rows", 28.57, 0.0),
    ]
    report = compare.report_comparison(sample_df, clean_df).collect()
    assert [r["Change"] for r in report] == ["▼ 2", "—", "▼ 4", "▼ 2", "▼ 14.29", "▼ 28.57", "—"]
    measured = compare.measure(sample_df, clean_df)
    assert compare.before_after(sample_df, clean_df, measured).collect() == rows
    gain = compare.quality_improvement(sample_df, clean_df).first()
    assert gain["score_after"] == 100.0 and gain["band_after"] == "good"
    delta = compare.delta_metrics(sample_df, clean_df).first()
    assert (delta["rows"], delta["rows_delta"], delta["missing_delta"]) == (5, -2, -4)
    kpi = compare.kpi_deltas(clean_df, sample_df).first()
    assert kpi["rows_change"] == "▲ 2" and kpi["duplicates_removed"] == -2


# -- insights ----------------------------------------------------------------------


def test_insights_of_a_trend(trend_df):
    rows = insights.top_insights(trend_df).collect()
    assert len(rows) == 4
    kinds = [r["type"] for r in rows]
    assert max(kinds.count(k) for k in kinds) <= 2
    titles = {r["title"] for r in rows}
    assert "x and y are positively correlated" in titles and "Trend of `y` over `date`" in titles
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_categories(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, True), ("b", False)], "t string, b boolean")
    rows = insights.category_insights(df, full=True).collect()
    assert rows[0]["title"] == "Top categories in `t`" and "`a` (50.0% of records)" in rows[0]["description"]
    assert "`True`" in rows[1]["description"]
    split = insights.category_insights(df, full=True, count_missing=False).collect()
    assert split[0]["title"] == "Category split in `t`"


def test_long_category_is_told_in_full(spark):
    df = spark.createDataFrame([("y" * 100,), ("y" * 100,), ("z",)], "t string")
    assert "y" * 100 in insights.category_insights(df).first()["description"]


def test_no_insights(spark):
    df = spark.createDataFrame([(1.0, "x")] * 3, "id double, t string")
    assert insights.top_insights(df).count() == 0
    assert insights.trend_insights(df).count() == 0


def test_text_dates_make_a_trend(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02}", float(d)) for d in range(1, 9)] + [("?", 99.0)], "my_date string, v double")
    row = insights.trend_insights(df).first()
    assert row["score"] == pytest.approx(2.0) and row["columns"] == ["my_date", "v"]


# -- chart data -----------------------------------------------------------------------


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(None,)], "v double")
    rows = chartdata.histogram(df, ["v"], 3, lines=True).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [3, 3, 4] and rows[2]["hi"] == 9.0
    assert rows[0]["mean"] == 4.5 and rows[0]["median"] == 4.5
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(column(chartdata.histogram(flat, ["v"], 4), "count")) == 2
    assert chartdata.insight_distribution(df.toDF("user_id"), "user_id").count() == 0


def test_small_charts(sample_df, clean_df):
    assert column(chartdata.missing_per_column(sample_df), "Missing") == [1, 1, 1, 1]
    assert chartdata.missing_matrix(clean_df).count() == 0
    assert chartdata.missing_matrix(sample_df, rows=3, key=["age", "dept"]).count() == 3
    assert chartdata.correlation_matrix(sample_df.select("dept", "age")).count() == 0
    assert chartdata.correlation_matrix(clean_df).where("x = y and r = 1.0").count() == 3
    assert chartdata.scatter_sample(sample_df, "age", "salary", rows=2).count() == 2
    assert chartdata.top_categories(sample_df, "dept", 2).collect() == [("IT", 3), ("HR", 2)]
    assert chartdata.proportions(sample_df, "dept").first()["share"] == pytest.approx(3 / 7)
    assert chartdata.widest_columns(sample_df, 1) == ["salary"]
    shift = chartdata.distribution_shift(sample_df, clean_df)
    assert shift.count() == 60 and shift.agg(F.sum("count")).first()[0] == 11
    box = chartdata.box_statistics(sample_df, clean_df, "age").collect()
    assert [r["median"] for r in box] == [27.5, 35.0]


# -- history ----------------------------------------------------------------------------


@pytest.mark.parametrize("write", [False, True])
def test_history(sample_df, write):
    session = CleaningSession(sample_df, write_states=write)
    for i in range(4):
        session.apply(f"Step {i}", session.current.limit(6 - i), ["cut"], "Manual")
    assert session.labels() == ["Step 1: Step 1", "Step 2: Step 2", "Step 3: Step 3"]
    log = session.log().collect()
    assert (log[0]["#"], log[0]["Source"], log[0]["Steps Applied"], log[0]["Status"]) == (1, "Source: Manual", ["cut"], "Applied")
    assert column(session.log(short=True), "#") == [0, 1, 2]
    assert session.restore(1).count() == 5
    assert session.history_frame().count() == 1


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_change_sets_restore_every_state(spark):
    from clearwell.operators import columns, encode, scale
    from clearwell.plans.changes import difference

    raw = spark.createDataFrame(
        [(i, i % 3 or None, float(i) if i % 7 else None, "ab"[i % 2], {"m": i}) for i in range(60)] + [(None, 1, float("nan"), None, None)],
        "id int, g int, `x.1` double, t string, bag map<string,int>")
    key = ["id"]
    states = [raw]
    for step in (
        lambda d: d.fillna(0.0, ["`x.1`"]), lambda d: d.where("g is null or g != 2"), lambda d: columns.change_type(d, "g", "string"),
        lambda d: encode.label_encode(d, "t"), lambda d: scale.scale_numeric(d, "Standard"), lambda d: d.drop("t", "bag"),
        lambda d: columns.rename_column(d, "x.1", "y"), lambda d: d.unionByName(d.where("id = 1").selectExpr("* except (id)", "999 as id")), lambda d: d.limit(0),
    ):
        states.append(step(states[-1]))
    session = CleaningSession(raw, max_snapshots=len(states), key=key)
    for i, state in enumerate(states[1:]):
        session.apply(f"Step {i}", state)
        assert session.current.schema.names == state.schema.names and sorted_rows(session.current) == sorted_rows(state)
    for i in range(len(states) - 2, -1, -2):
        assert sorted_rows(session.restore(i)) == sorted_rows(states[i])
    with pytest.raises(ValueError, match="not told apart"):
        difference(raw.unionByName(raw), raw, key)
    with pytest.raises(ValueError, match="gone"):
        difference(raw, raw.drop("id"), key)


def test_a_change_set_is_a_fraction_of_the_table(spark, tmp_path, monkeypatch):
    import os

    from clearwell.plans import changes

    raw = spark.range(20_000).selectExpr("id", "rand(1) as x", "rand(2) as y", "uuid() as t")
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    monkeypatch.setattr(changes, "materialize", lambda df, label: (df.write.parquet(str(tmp_path / "changes")), spark.read.parquet(str(tmp_path / "changes")))[1])
    session = CleaningSession(raw, key=["id"])
    after = raw.selectExpr("id", "if(id % 100 = 0, 0.0, x) as x", "y", "t")
    session.apply("one in a hundred", after)
    size = {n: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / n) for f in fs if f.endswith(".parquet")) for n in ("raw", "changes")}
    assert size["changes"] < 0.05 * size["raw"] and sorted_rows(session.current) == sorted_rows(after)


def test_row_counts_are_kept(full_df):
    from clearwell.operators import encode, invalid, scale, text

    for step in (
        lambda d: missing.handle_missing_values(d, "Mean"), invalid.replace_invalid_values,
        text.standardize_text_columns, scale.scale_numeric, lambda d: encode.label_encode(d, "cat"),
    ):
        assert step(full_df).count() == 6
