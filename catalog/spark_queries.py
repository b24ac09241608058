"""The catalog: name -> query over a folder of test tables."""

from pyspark.sql import DataFrame, functions as F

from clearwell.functions import stats
from clearwell.functions.storage import fresh_path
from clearwell.operators import (
    columns,
    dedupe,
    encode,
    invalid,
    isolation,
    missing,
    outliers,
    ranges,
    scale,
    text,
)
from clearwell.plans import chartdata, compare, insights, profile, suggest
from clearwell.plans.session import CleaningSession
from clearwell.sources import reader, writer

from .inputs import (
    cleaned,
    dirty,
    levels,
    mixed,
    raw_text,
    related,
    replies,
    table,
    typed_text,
)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def _dated(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps as text, for a comparison that does not depend on their type."""
    return df.withColumns({c: F.col(c).cast("string") for c in names})


def _keys_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("o_orderkey", "o_custkey")})


# -- sources and sinks ------------------------------------------------------- #


def s1_load_csv(spark, folder):
    path = fresh_path(spark, "raw") + ".csv"
    raw_text(spark, folder).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    df, _ = reader.load_dataset(spark, path)
    return df


def s2_null_tokens(spark, folder):
    return reader.normalise_nulls(raw_text(spark, folder))


def s3_inferred_types(spark, folder):
    return reader.inferred_types(reader.normalise_nulls(raw_text(spark, folder)))


def s4_export_csv(spark, folder):
    path = writer.export_csv(dirty(spark, folder), fresh_path(spark, "export"), "orders")
    df, _ = reader.load_dataset(spark, path)
    return df


def s5_report(spark, folder):
    session = CleaningSession(dirty(spark, folder))
    session.apply("Missing: Drop", session.current.na.drop("any"))
    session.apply("Drop Duplicates", session.current.dropDuplicates(), ["Dropped copies"])
    target = fresh_path(spark, "report")
    writer.write_report(session.raw, session.current, target, session.history, ["o_orderkey"])
    comparison = spark.read.parquet(f"{target}/3_comparison").select(
        F.lit("comparison").alias("section"),
        F.col("Metric").alias("item"),
        F.col("Before Cleaning").alias("first"),
        F.col("After Cleaning").alias("second"),
        F.col("Change").alias("third"),
    )
    schema = spark.read.parquet(f"{target}/4_schema").select(
        F.lit("schema"), "Column", F.col("Missing").cast("string"), "Missing %",
        F.col("Unique Values").cast("string"),
    )
    log = spark.read.parquet(f"{target}/5_cleaning_log").select(
        F.lit("log"), F.col("#").cast("string"), "Operation",
        F.array_join("Steps Applied", "; "), "Status",
    )
    return comparison.union(schema).union(log)


# -- columns ----------------------------------------------------------------- #


def p1_column_classes(spark, folder):
    from clearwell.functions import types

    df = dirty(spark, folder)
    classes = {
        "numeric": types.numeric_columns(df),
        "other": types.other_columns(df),
        "text": types.text_columns(df),
        "date-like": types.date_like_columns(df),
        "id-like": [c for c in df.columns if types.is_id_like(c)],
    }
    aggs = [
        F.struct(
            F.lit(k).alias("class"), F.lit(c).alias("column"), F.count(F.col(c)).alias("present")
        )
        for k, names in classes.items()
        for c in names
    ]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def p2_rename(spark, folder):
    df = columns.rename_column(dirty(spark, folder), "prio", "priority")
    df = columns.rename_column(df, "status", "price")
    return _dated(df, "odate")


def p3_change_type(spark, folder):
    df = typed_text(spark, folder)
    df = df.withColumns({"as_int": F.col("amount"), "as_float": F.col("amount")})
    df = columns.change_type(df, "as_int", "int")
    df = columns.change_type(df, "as_float", "float")
    df = columns.change_type(df, "placed", "datetime")
    df = columns.change_type(df, "o_orderkey", "string")
    return _dated(df.drop("amount"), "placed")


def p4_drop_column(spark, folder):
    df = columns.drop_column(dirty(spark, folder), "odate")
    return columns.drop_column(df, "absent")


def p5_encode_dispatch(spark, folder):
    df = dirty(spark, folder).select("o_orderkey", "o_custkey", "prio")
    df = columns.apply_column_operation(df, "Encode categorical", "prio")
    return columns.apply_column_operation(
        df, "Encode categorical", "o_custkey", order_by="o_orderkey"
    ).drop("prio")


def p6_clean_names(spark, folder):
    df = table(spark, folder, "nation").toDF(" Nation Key", "N-Name", "Region/Key ")
    return columns.clean_column_names(df)


def p7_filter_by_flag(spark, folder):
    df = dirty(spark, folder)
    flag = outliers.fit_iqr(df).flag()
    return _dated(columns.keep_unflagged(df, flag), "odate")


def p8_preview(spark, folder):
    df = table(spark, folder, "lineitem")
    return _dated(columns.preview(df, ["l_orderkey", "l_linenumber", "l_partkey"], 10, 10).drop("l_shipdate"))


# -- profile ----------------------------------------------------------------- #


def m1_basic_metrics(spark, folder):
    return profile.basic_metrics(dirty(spark, folder))


def m2_dtype_summary(spark, folder):
    return profile.dtype_summary(dirty(spark, folder))


def m2_dtype_summary_documents(spark, folder):
    return profile.dtype_summary(table(spark, folder, "documents"))


def m3_quality_score(spark, folder):
    return _rounded(profile.quality_score(dirty(spark, folder)), 6, "score")


def m4_numeric_summary(spark, folder):
    return profile.numeric_summary(
        table(spark, folder, "lineitem").drop("l_orderkey", "l_partkey", "l_suppkey")
    )


def m5_feature_types(spark, folder):
    return profile.detect_feature_types(table(spark, folder, "documents"))


def m6_profile_text(spark, folder):
    return profile.profile_text(dirty(spark, folder))


def m7_report_schema(spark, folder):
    return profile.report_schema(dirty(spark, folder))


def m8_quality_band(spark, folder):
    score = profile.quality_score(dirty(spark, folder))
    return score.select(F.round("score", 4).alias("score"), profile.quality_band(F.col("score")).alias("band"))


# -- cleaning ---------------------------------------------------------------- #


def c1_drop_incomplete(spark, folder):
    return _dated(missing.handle_missing_values(dirty(spark, folder), "Drop"), "odate")


def c2_mean_fill(spark, folder):
    df = missing.handle_missing_values(dirty(spark, folder), "Mean")
    return _dated(_rounded(df, 4, "price"), "odate")


def c3_median_fill(spark, folder):
    df = missing.handle_missing_values(dirty(spark, folder), "Median")
    return _dated(_rounded(df, 4, "price"), "odate")


def c4_mode_fill(spark, folder):
    df = missing.handle_missing_values(dirty(spark, folder), "Mode")
    return _dated(df, "odate")


def c5_knn_impute(spark, folder):
    df = missing.handle_missing_values(dirty(spark, folder), "KNN Imputation")
    return _dated(_rounded(df, 4, "price"), "odate")


def c6_most_frequent_fill(spark, folder):
    df = missing.handle_missing_values(mixed(spark, folder), "Mean")
    return _dated(df, "day")


def c7_drop_duplicates(spark, folder):
    return _dated(dedupe.drop_duplicates(dirty(spark, folder)), "odate")


def c8_iqr_flags(spark, folder):
    df = outliers.detect_outliers_iqr(dirty(spark, folder))
    return df.select("o_orderkey", "price", "is_outlier")


def c8_iqr_flags_events(spark, folder):
    df = outliers.detect_outliers_iqr(table(spark, folder, "events"))
    return df.select("event_id", "is_outlier")


def c9_zscore_flags(spark, folder):
    df = outliers.detect_outliers_zscore(dirty(spark, folder), 3.0)
    return df.select("o_orderkey", "price", "is_outlier")


def c10_isolation_forest(spark, folder):
    return isolation.flag_anomalies(table(spark, folder, "lineitem"), key=["l_orderkey", "l_linenumber"])


def c11_remove_outliers_iqr(spark, folder):
    return _dated(outliers.remove_outliers(cleaned(spark, folder), "IQR"), "odate")


def c11_remove_outliers_zscore(spark, folder):
    df = outliers.remove_outliers(dirty(spark, folder), "Z-Score", threshold=2.5)
    return _dated(df, "odate")


def c12_invalid_tokens(spark, folder):
    return _dated(invalid.replace_invalid_values(raw_text(spark, folder)), "odate")


def c13_negative_invalid(spark, folder):
    df = invalid.replace_invalid_values(dirty(spark, folder), treat_negative_as_invalid=True)
    return _dated(df, "odate")


def c14_standardize_text(spark, folder):
    return text.standardize_text_columns(table(spark, folder, "documents"))


def c15_standardize_categories(spark, folder):
    mapping = {" 1-Urgent": "Top", "2-HIGH": "Top", "5-low ": "Rest", "5-Low": "Other"}
    return text.standardize_categories(dirty(spark, folder), "prio", mapping).drop("odate")


def c16_validate_range(spark, folder):
    df = dirty(spark, folder).select("o_orderkey", "price", F.col("price").alias("kept"))
    df = ranges.validate_range(df, "price", 20_000, 300_000)
    return ranges.validate_range(df, "kept", 20_000, 300_000, mode="nan")


def c17_label_encode(spark, folder):
    return encode.label_encode(dirty(spark, folder), "prio").select("o_orderkey", "prio", "prio_encoded")


def c18_factorize(spark, folder):
    df = encode.factorize(dirty(spark, folder), "price", order_by="o_orderkey")
    return df.select("o_orderkey", "price", "price_encoded")


def c19_one_hot(spark, folder):
    return _dated(encode.one_hot_encode(dirty(spark, folder), "status"), "odate")


def c20_min_max(spark, folder):
    df = scale.scale_numeric(table(spark, folder, "lineitem"), "Min-Max")
    names = [c for c in df.columns if c.endswith("_scaled")]
    return _rounded(df, 8, *names).select("l_orderkey", "l_linenumber", "l_partkey", *names)


def c21_standard(spark, folder):
    df = scale.scale_numeric(dirty(spark, folder), "Standard")
    names = [c for c in df.columns if c.endswith("_std")]
    return _rounded(df, 6, *names).select("o_orderkey", *names)


# -- suggestions and automatic cleaning --------------------------------------- #


def g1_rule_suggestions(spark, folder):
    return suggest.rule_based_suggestions(dirty(spark, folder))


def g2_basic_rule_suggestions(spark, folder):
    return suggest.rule_based_suggestions(table(spark, folder, "lineitem"), rules="basic")


def g3_parse_replies(spark, folder):
    return suggest.parse_replies(replies(spark, folder), "reply", ["conv_id", "turn"])


def g4_generate_suggestions(spark, folder):
    return suggest.generate_suggestions(table(spark, folder, "events"))


def g5_auto_clean(spark, folder):
    df, _, _ = suggest.auto_clean(dirty(spark, folder))
    return _dated(_rounded(df, 4, "price"), "odate")


def g5_auto_clean_steps(spark, folder):
    _, steps, source = suggest.auto_clean(dirty(spark, folder))
    return stats.small_frame(
        spark, [(i, s, source) for i, s in enumerate(steps, 1)], "step int, done string, source string"
    )


# A model reply for the table ``dirty``.
SUGGESTED = [
    ("price", "Negative prices", "Impute Median", "High"),
    ("-", "Duplicate rows", "Remove duplicates", "Medium"),
    ("prio", "Untidy spelling", "Strip and lower", "Low"),
    ("status", "Categorical", "Label encoding", "Low"),
    ("o_custkey", "Foreign identifier", "Drop column", "Low"),
    ("price", "Outliers", "Remove using IQR", "Medium"),
    ("price", "Wide range", "Scale values", "Low"),
]


def _suggested(spark, df):
    reply = stats.small_frame(
        spark, [(i, *row) for i, row in enumerate(SUGGESTED)], suggest.SCHEMA
    )
    return suggest.generate_suggestions(df, from_model=reply)


def g6_guided_clean(spark, folder):
    df = dirty(spark, folder)
    out, _, _ = suggest.auto_clean(df, _suggested(spark, df))
    names = [c for c in out.columns if c.endswith("_std")]
    return _dated(_rounded(out, 4, "price", *names), "odate")


def g6_guided_clean_steps(spark, folder):
    df = dirty(spark, folder)
    _, steps, source = suggest.auto_clean(df, _suggested(spark, df))
    return stats.small_frame(
        spark, [(i, s, source) for i, s in enumerate(steps, 1)], "step int, done string, source string"
    )


# -- comparison --------------------------------------------------------------- #


def b1_before_after(spark, folder):
    return compare.before_after(dirty(spark, folder), cleaned(spark, folder))


def b2_delta_metrics(spark, folder):
    df = compare.delta_metrics(dirty(spark, folder), cleaned(spark, folder))
    return _rounded(df, 6, "score", "score_delta")


def b3_report_comparison(spark, folder):
    return compare.report_comparison(dirty(spark, folder), cleaned(spark, folder))


def b4_quality_improvement(spark, folder):
    df = compare.quality_improvement(dirty(spark, folder), cleaned(spark, folder))
    return _rounded(df, 6, "score_before", "score_after", "improvement", "improvement_pct")


def b5_kpi_deltas(spark, folder):
    return compare.kpi_deltas(dirty(spark, folder), cleaned(spark, folder))


# -- insights ------------------------------------------------------------------ #


def _told(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"score": F.round("score", 6), "columns": F.array_join("columns", ",")}
    )


def i1_distributions(spark, folder):
    return _told(insights.distribution_insights(table(spark, folder, "lineitem")))


def i2_correlations(spark, folder):
    return _told(insights.correlation_insights(related(spark, folder)))


def i3_categories(spark, folder):
    return _told(insights.category_insights(dirty(spark, folder)))


def i3_categories_documents(spark, folder):
    return _told(insights.category_insights(table(spark, folder, "documents"), full=True))


def i4_trend(spark, folder):
    return _told(insights.trend_insights(levels(spark, folder)))


def i5_top_insights(spark, folder):
    return _told(insights.top_insights(related(spark, folder)))


# -- chart data ----------------------------------------------------------------- #


def v1_missing_bar(spark, folder):
    return chartdata.missing_per_column(dirty(spark, folder))


def v2_missing_matrix(spark, folder):
    return chartdata.missing_matrix(dirty(spark, folder), key=["o_orderkey"])


def v3_correlation_matrix(spark, folder):
    return chartdata.correlation_matrix(related(spark, folder), max_columns=12)


def v4_distributions(spark, folder):
    return _rounded(chartdata.distributions(related(spark, folder)), 4, "lo", "hi")


def v4_report_distributions(spark, folder):
    df = chartdata.report_distributions(cleaned(spark, folder))
    return _rounded(df, 4, "lo", "hi", "mean", "median")


def v5_box_statistics(spark, folder):
    df = chartdata.box_statistics(dirty(spark, folder), cleaned(spark, folder), "price")
    return _rounded(df, 4, "q1", "median", "q3", "whisker_low", "whisker_high", "mean", "sd")


def v6_top_categories(spark, folder):
    return chartdata.top_categories(table(spark, folder, "part"), "p_type")


def v7_proportions(spark, folder):
    return _rounded(chartdata.proportions(dirty(spark, folder), "prio"), 8, "share")


def v8_daily_series(spark, folder):
    df = chartdata.daily_series(table(spark, folder, "events"), "ts", "value")
    return _dated(_rounded(df, 6, "mean"), "day")


def v9_scatter_sample(spark, folder):
    return chartdata.scatter_sample(
        dirty(spark, folder), "o_custkey", "price", key=["o_orderkey"]
    )


def v10_insight_distribution(spark, folder):
    df = chartdata.insight_distribution(table(spark, folder, "events"), "value")
    return _rounded(df, 4, "lo", "hi", "mean", "median")


def v11_distribution_shift(spark, folder):
    raw = dirty(spark, folder).select("price")
    df = chartdata.distribution_shift(raw, cleaned(spark, folder).select("price"))
    return _rounded(df, 4, "lo", "hi")


def v12_before_after_counts(spark, folder):
    return compare.before_after_counts(dirty(spark, folder), cleaned(spark, folder))


# -- history --------------------------------------------------------------------- #


def _session(spark, folder, **options):
    session = CleaningSession(dirty(spark, folder), **options)
    for label, step in (
        ("Missing: Mean", lambda d: missing.handle_missing_values(d, "Mean")),
        ("Drop Duplicates", dedupe.drop_duplicates),
        ("Text Standardization", text.standardize_text_columns),
        ("Outliers (IQR)", outliers.remove_outliers),
    ):
        session.apply(label, step(session.current), [f"Applied {label}"])
    return session


def h1_history(spark, folder):
    """The kept steps with the size of the table before each."""
    session = _session(spark, folder)
    sizes = [
        s.before.agg(F.lit(i).alias("position"), F.count(F.lit(1)).alias("rows_before"))
        for i, s in enumerate(session.history)
    ]
    counted = sizes[0]
    for part in sizes[1:]:
        counted = counted.union(part)
    kept = session.history_frame().withColumn("steps", F.array_join("steps", "; "))
    return kept.join(counted, "position")


def h2_restore(spark, folder):
    session = _session(spark, folder)
    restored = session.restore(1)
    return _dated(_rounded(restored, 4, "price"), "odate")


def h3_cleaning_log(spark, folder):
    session = _session(spark, folder)
    log = session.log().withColumn("Steps Applied", F.array_join("Steps Applied", "; "))
    return log.withColumn("rows_now", F.lit(session.current.count()))


QUERIES = {
    name: query
    for name, query in list(globals().items())
    if name[0] in "spmcgbivh" and name[1].isdigit() and callable(query)
}
