"""Profiles of one table: metrics, column summary, quality score, statistics."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import stats
from ..functions.types import is_datetime, numeric_columns, ref, truth_columns
from ..operators.outliers import IqrModel, fit_iqr


def basic_metrics(df: DataFrame) -> DataFrame:
    """One row: rows, cols, missing (NULL cells), duplicates (rows beyond the first
    copy). A single pass over distinct rows answers all of them."""
    n = F.col("__n")
    return stats.grouped_rows(df, [stats.null_cells(df).alias("__nulls")]).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("cols"),
        F.coalesce(F.sum(n * F.col("__nulls")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"),
    )


def dtype_summary(df: DataFrame, approx: bool = False, accuracy: float | None = None) -> DataFrame:
    """Column, Data Type, Non-Null Count, Missing Count, Missing %, Unique Values in
    column order. ``approx`` trades the exchange of distinct values for sketches, of some 5 %
    error; ``accuracy`` asks for sketches of another standard error. A task then sends (1.04 /
    accuracy)² bytes per column at most, whatever its rows."""
    names = stats.small_frame(
        df.sparkSession,
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "ordinal int, name string, type string",
    )
    counts = _sketched_counts(df, accuracy) if accuracy else _approx_counts(df) if approx else _exact_counts(df)
    # One row per column on both sides.
    joined = F.broadcast(names).join(F.broadcast(counts), "ordinal", "left")
    present = F.coalesce("present", F.lit(0))
    missing = F.coalesce("missing", F.lit(0))
    return joined.orderBy("ordinal").select(
        F.col("name").alias("Column"),
        F.col("type").alias("Data Type"),
        present.alias("Non-Null Count"),
        missing.alias("Missing Count"),
        F.round(
            F.coalesce(F.try_divide(missing.cast("double"), present + missing) * 100, F.lit(0.0)), 2
        ).alias("Missing %"),
        F.coalesce("distinct", F.lit(0)).alias("Unique Values"),
    )


def _exact_counts(df: DataFrame) -> DataFrame:
    given = stats.has_value()
    return (
        stats.value_counts(df, df.columns, shorten=True)
        .groupBy("ordinal")
        .agg(
            F.sum(F.when(given, F.col("n"))).alias("present"),
            F.sum(F.when(~given, F.col("n"))).alias("missing"),
            F.count_if(given).alias("distinct"),
        )
    )


def _approx_counts(df: DataFrame) -> DataFrame:
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(ref(c)).alias(f"p{i}") for i, c in enumerate(df.columns)],
        *[F.approx_count_distinct(ref(c)).alias(f"u{i}") for i, c in enumerate(df.columns)],
    )
    per_column = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.col(f"p{i}").alias("present"),
            (F.col("rows") - F.col(f"p{i}")).alias("missing"),
            F.col(f"u{i}").alias("distinct"),
        )
        for i in range(len(df.columns))
    ]
    return wide.select(F.inline(F.array(*per_column)))


def sketch_size(accuracy: float) -> int:
    """log2 of the registers of a distinct-value sketch of that relative standard error."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / accuracy))))


def _sketched_counts(df: DataFrame, accuracy: float) -> DataFrame:
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.when(stats.present(df, f.name), F.xxhash64(stats.plain_text(f))).alias("mark"))
        for i, f in enumerate(df.schema)
    ]
    return df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.ordinal").agg(
        F.count("c.mark").alias("present"), F.count_if(F.col("c.mark").isNull()).alias("missing"),
        F.hll_sketch_estimate(F.hll_sketch_agg("c.mark", sketch_size(accuracy))).alias("distinct"))


def quality_score(
    df: DataFrame, model: IqrModel | None = None, accuracy: int | None = None
) -> DataFrame:
    """``basic_metrics`` plus ``outliers`` (rows outside the IQR fences) and ``score``:
    100 less 40 for missing cells, 30 for duplicate rows and 30 for outlier rows,
    each by its share. An empty table scores 0."""
    model = model or fit_iqr(df, accuracy=accuracy)
    n = F.col("__n")
    facts = [stats.null_cells(df).alias("__nulls"), model.flag().alias("__flag")]
    counted = stats.grouped_rows(df, facts).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("cols"),
        F.coalesce(F.sum(n * F.col("__nulls")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("__flag"), n)), F.lit(0)).alias("outliers"),
    )
    return counted.withColumn("score", score_of())


def score_of() -> Column:
    def penalty(share, weight):
        return F.least(share, F.lit(1.0)) * weight

    rows = F.col("rows").cast("double")
    cells = rows * F.greatest(F.col("cols"), F.lit(1))
    score = (
        F.lit(100.0)
        - penalty(F.try_divide(F.col("missing"), cells), 40.0)
        - penalty(F.try_divide(F.col("duplicates"), rows), 30.0)
        - penalty(F.try_divide(F.col("outliers"), rows), 30.0)
    )
    return F.when((F.col("rows") == 0) | (F.col("cols") == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    )


def quality_band(score: Column) -> Column:
    return F.when(score < 40, "poor").when(score < 70, "fair").otherwise("good")


@dataclass
class TableMetrics:
    rows: int
    cols: int
    missing: int
    duplicates: int
    outliers: int
    score: float


def table_metrics(df: DataFrame) -> TableMetrics:
    return TableMetrics(**quality_score(df).first().asDict())


SUMMARY_COLUMNS = (
    "count", "mean", "std", "min", "25%", "50%", "75%", "max", "skewness", "kurtosis",
)


def numeric_summary(
    df: DataFrame, digits: int = 4, accuracy: int | None = None
) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max, bias-corrected
    skewness and excess kurtosis."""
    columns = numeric_columns(df)
    found = stats.moments(df, columns, shape=True) if columns else stats.TableMoments(0)
    quartiles = stats.quantiles(df, columns, [0.25, 0.5, 0.75], accuracy, found)
    rows = []
    for i, c in enumerate(columns):
        m = found.columns[c]
        std = None if m.variance is None else m.variance**0.5
        rows.append(
            (i, c, float(m.n), m.mean, std, m.low, *quartiles[c], m.high, m.skew, m.kurtosis)
        )
    schema = "ordinal int, `Column` string, " + ", ".join(
        f"`{c}` double" for c in SUMMARY_COLUMNS
    )
    frame = stats.small_frame(df.sparkSession, rows, schema)
    return frame.orderBy("ordinal").select(
        "Column", *[F.round(ref(c), digits).alias(c) for c in SUMMARY_COLUMNS]
    )


def detect_feature_types(df: DataFrame) -> DataFrame:
    """Numeric (truth values too) and Date by type; the rest is Categorical up to
    max(10, min(100, 5 % of the rows)) distinct values, else Text."""
    numeric = numeric_columns(df) + truth_columns(df)
    dates = [f.name for f in df.schema if is_datetime(f.dataType)]
    total = ref("Non-Null Count") + ref("Missing Count")
    limit = F.greatest(F.lit(10), F.least(F.lit(100), F.floor(total * 0.05)))
    return dtype_summary(df).select(
        "Column",
        ref("Data Type"),
        F.when(ref("Column").isin(numeric), "Numeric")
        .when(ref("Column").isin(dates), "Date")
        .when(ref("Unique Values") <= limit, "Categorical")
        .otherwise("Text")
        .alias("Inferred Type"),
        ref("Unique Values"),
    )


def report_schema(df: DataFrame, max_columns: int = 20) -> DataFrame:
    """Schema table of the report: first columns, short names, one-decimal shares."""
    shown = df.select(*[ref(c) for c in df.columns[:max_columns]])
    total = F.greatest(ref("Non-Null Count") + ref("Missing Count"), F.lit(1))
    return dtype_summary(shown).select(
        F.substring(ref("Column"), 1, 30).alias("Column"),
        ref("Data Type").alias("Type"),
        ref("Missing Count").alias("Missing"),
        F.format_string("%.1f%%", ref("Missing Count") / total * 100).alias("Missing %"),
        ref("Unique Values"),
    )


@dataclass
class ColumnProfile:
    name: str
    dtype: T.DataType
    present: int
    missing: int
    unique: int

    @property
    def missing_pct(self) -> float:
        total = self.present + self.missing
        return self.missing / total * 100 if total else 0.0


def column_profiles(df: DataFrame) -> list[ColumnProfile]:
    """``dtype_summary`` as driver-side objects, one per column."""
    rows = dtype_summary(df).collect()
    return [
        ColumnProfile(
            f.name, f.dataType, r["Non-Null Count"], r["Missing Count"], r["Unique Values"]
        )
        for f, r in zip(df.schema, rows)
    ]


def profile_text(df: DataFrame, full: bool = False) -> DataFrame:
    """The profile as one text cell. ``full`` prints skewness 0.00 where fewer than
    three values make it undefined; otherwise the figures are left out there."""
    profiles = column_profiles(df)
    numeric = numeric_columns(df) + truth_columns(df)
    found = stats.moments(df, numeric, shape=True).columns if numeric else {}
    metrics = basic_metrics(df).first()
    lines = [
        f"Dataset shape: {metrics['rows']} rows x {len(df.columns)} columns",
        "",
        "Column details:",
    ]
    for p in profiles:
        line = (
            f"  - '{p.name}': dtype={p.dtype.simpleString()}, "
            f"missing={p.missing_pct:.1f}%, unique_values={p.unique}"
        )
        m = found.get(p.name)
        if m is not None and (m.n > 2 or full):
            skew = m.skew if m.n > 2 else 0.0
            line += f", skewness={skew:.2f}, has_negatives={m.n > 0 and m.low < 0}"
        lines.append(line)
    lines += ["", f"Duplicate rows: {metrics['duplicates']}"]
    return stats.small_frame(df.sparkSession, [("\n".join(lines),)], "profile string")
