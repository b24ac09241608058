"""The table before and after cleaning."""

from pyspark.sql import DataFrame, functions as F

from ..functions import stats
from ..functions.exprs import significant
from ..functions.storage import settled
from ..functions.types import ref
from . import profile

COUNT_METRICS = ("Rows", "Columns", "Missing Values", "Duplicate Rows")
METRICS_SCHEMA = (
    "rows bigint, cols bigint, missing bigint, duplicates bigint, outliers bigint, score double"
)
SHARE_METRICS = ("Missing % of Cells", "Duplicate % of Rows")


def _versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row with the metrics of both versions as ``b_*`` and ``a_*``."""
    both = before.withColumn("version", F.lit("b")).unionByName(
        after.withColumn("version", F.lit("a"))
    )
    return both.agg(
        *[
            F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{v}_{c}")
            for v in "ba"
            for c in before.columns
        ]
    )


Measured = tuple[profile.TableMetrics, profile.TableMetrics]


def measure(raw: DataFrame, clean: DataFrame) -> Measured:
    """Metrics of both versions, for several comparisons to share."""
    return profile.table_metrics(settled(raw, "raw-version")), profile.table_metrics(settled(clean, "clean-version"))


def _row(raw, clean, measured: Measured | None, score: bool = False) -> DataFrame:
    if measured is not None:
        before, after = (
            stats.small_frame(raw.sparkSession, [tuple(vars(m).values())], METRICS_SCHEMA)
            for m in measured
        )
        return _versions(before, after)
    if not score:  # one reading each
        return _versions(profile.basic_metrics(raw), profile.basic_metrics(clean))
    return _versions(
        profile.quality_score(settled(raw, "raw-version")), profile.quality_score(settled(clean, "clean-version"))
    )


def before_after(
    raw: DataFrame, clean: DataFrame, measured: Measured | None = None
) -> DataFrame:
    """Six rows: Metric, Before, After."""
    return _comparison(_row(raw, clean, measured))


def comparison_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """``before_after`` of metrics that are known: one row each, as of ``basic_metrics``."""
    return _comparison(_versions(before, after))


def _comparison(row: DataFrame) -> DataFrame:
    def values(v):
        rows, cols, missing, copies = (
            F.col(f"{v}_{c}").cast("double") for c in ("rows", "cols", "missing", "duplicates")
        )
        return (
            rows,
            cols,
            missing,
            copies,
            F.round(missing / F.greatest(rows * cols, F.lit(1.0)) * 100, 2),
            F.round(copies / F.greatest(rows, F.lit(1.0)) * 100, 2),
        )

    lines = [
        F.struct(F.lit(m).alias("Metric"), b.alias("Before"), a.alias("After"))
        for m, b, a in zip(COUNT_METRICS + SHARE_METRICS, values("b"), values("a"))
    ]
    return row.select(F.inline(F.array(*lines)))


def before_after_counts(
    raw: DataFrame, clean: DataFrame, measured: Measured | None = None
) -> DataFrame:
    """The count rows of the comparison, as charted."""
    return before_after(raw, clean, measured).where(ref("Metric").isin(*COUNT_METRICS))


def delta_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: metrics after a step and their change by it."""
    row = _row(before, after, None, score=True)
    measures = ("rows", "missing", "duplicates", "score")
    return row.select(
        *[F.col(f"a_{c}").alias(c) for c in measures],
        *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_delta") for c in measures],
    )


def quality_improvement(
    raw: DataFrame, clean: DataFrame, measured: Measured | None = None
) -> DataFrame:
    """One row: score before and after, gain, and gain in percent of the former."""
    row = _row(raw, clean, measured, score=True)
    before, after = F.col("b_score"), F.col("a_score")
    return row.select(
        before.alias("score_before"),
        after.alias("score_after"),
        (after - before).alias("improvement"),
        F.coalesce(F.try_divide(after - before, before) * 100, F.lit(0.0)).alias("improvement_pct"),
        profile.quality_band(after).alias("band_after"),
    )


def kpi_deltas(
    raw: DataFrame, clean: DataFrame, measured: Measured | None = None
) -> DataFrame:
    """One row of report figures: counts before and after, duplicates removed."""
    row = _row(raw, clean, measured)
    return row.select(
        F.col("b_rows").alias("rows_before"),
        F.col("a_rows").alias("rows_after"),
        _arrow(F.col("a_rows") - F.col("b_rows")).alias("rows_change"),
        F.col("b_cols").alias("columns"),
        F.col("b_missing").alias("missing_before"),
        F.col("a_missing").alias("missing_after"),
        _arrow(F.col("a_missing") - F.col("b_missing")).alias("missing_change"),
        (F.col("b_duplicates") - F.col("a_duplicates")).alias("duplicates_removed"),
    )


def _arrow(change):
    count = F.format_string("%,d", F.abs(change))
    return (
        F.when(change < 0, F.concat(F.lit("▼ "), count))
        .when(change > 0, F.concat(F.lit("▲ "), count))
        .otherwise("—")
    )


# The report's lines and the form of their figures.
REPORT_LINES = (
    ("Total Rows", "Rows", "%.0f"),
    ("Total Columns", "Columns", "%.0f"),
    ("Missing Values", "Missing Values", "%.0f"),
    ("Duplicate Rows", "Duplicate Rows", "%.0f"),
    ("Missing % of Cells", "Missing % of Cells", "%.2f%%"),
    ("Duplicate % of Rows", "Duplicate % of Rows", "%.2f%%"),
    ("Data Quality Score", "score", "%.2f / 100"),
)


def report_comparison(
    raw: DataFrame, clean: DataFrame, measured: Measured | None = None
) -> DataFrame:
    """Comparison as report text, with the direction of each change. The quality row
    carries no change mark."""
    row = _row(raw, clean, measured or measure(raw, clean))
    scores = row.select(
        F.lit("score").alias("Metric"), F.col("b_score").alias("Before"), F.col("a_score").alias("After")
    )
    forms = stats.small_frame(
        raw.sparkSession,
        [(i, *line) for i, line in enumerate(REPORT_LINES)],
        "position int, label string, name string, form string",
    )
    change = F.col("After") - F.col("Before")
    mark = (
        F.when(F.col("name") == "score", "—")
        .when(change < 0, F.concat(F.lit("▼ "), significant(-change, 6)))
        .when(change > 0, F.concat(F.lit("▲ "), significant(change, 6)))
        .otherwise("—")
    )
    texts = [
        F.coalesce(*[
            F.when(F.col("form") == form, F.format_string(form, F.col(side)))
            for form in dict.fromkeys(line[2] for line in REPORT_LINES)
        ]).alias(f"{side} Cleaning")
        for side in ("Before", "After")
    ]
    # Seven rows on either side.
    return (
        _comparison(row).unionByName(scores)
        .join(F.broadcast(forms), F.col("Metric") == F.col("name"))
        .orderBy("position")
        .select(F.col("label").alias("Metric"), *texts, mark.alias("Change"))
    )
