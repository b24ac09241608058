"""Writing the cleaned table and the report tables."""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import stats
from ..functions.exprs import significant
from ..functions.storage import materialize
from ..functions.types import OPAQUE_TYPES, is_datetime, numeric_columns, ref
from ..plans import chartdata, compare, profile
from ..plans.session import Step, cleaning_log


def to_json_text(field: T.StructField):
    """A nested cell as JSON, bytes in base 64."""
    return F.base64(ref(field.name)) if isinstance(field.dataType, T.BinaryType) else F.to_json(ref(field.name))


def export_csv(df: DataFrame, folder: str, base: str = "dataset") -> str:
    """Write ``<folder>/<base>_cleaned.csv`` in parallel parts, UTF-8 with header, NULL
    as an empty cell. Dates are written as plain text, nested cells as JSON."""
    cells = []
    for f in df.schema:
        cell = ref(f.name)
        if isinstance(f.dataType, OPAQUE_TYPES):
            cell = to_json_text(f)
        elif is_datetime(f.dataType):
            cell = cell.cast("string")
        cells.append(cell.alias(f.name))
    path = f"{folder.rstrip('/')}/{base}_cleaned.csv"
    df.select(*cells).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


def export_parquet(df: DataFrame, folder: str, base: str = "dataset") -> str:
    path = f"{folder.rstrip('/')}/{base}_cleaned.parquet"
    df.write.parquet(path)
    return path


# Heads of the statistics table and the mark of a missing cell.
STATISTICS_HEADS = ("Count", "Mean", "Std Dev", "Min", "25%", "50%", "75%", "Max", "Skewness", "Kurtosis")
NO_VALUE = "—"


def report_statistics(df: DataFrame) -> DataFrame:
    """Numeric summary as report text, names cut to 22 characters: four decimals, or an
    exponent for very large and very small figures."""

    def text(name):
        size = F.abs(ref(name))
        far = (size >= 1e6) | ((size > 0) & (size < 1e-3))
        shown = F.when(far, F.format_string("%.3e", ref(name))).otherwise(F.format_string("%.4f", ref(name)))
        return F.when(ref(name).isNull(), "nan").otherwise(shown)

    summary = profile.numeric_summary(df, digits=12)
    return summary.select(
        F.substring("Column", 1, 22).alias("Column"),
        *[text(c).alias(head) for c, head in zip(profile.SUMMARY_COLUMNS, STATISTICS_HEADS)],
    )


def report_preview(
    df: DataFrame, order_by: list[str] | None = None, rows: int = 5, max_columns: int = 10
) -> DataFrame:
    """The first rows as report text, numbered from 0."""
    spark = df.sparkSession
    columns = df.columns[:max_columns]
    if not columns:
        note = [(NO_VALUE, "No columns available in this dataset state.")]
        return stats.small_frame(spark, note, "`#` string, `Message` string")
    cells = []
    for f in df.schema[:max_columns]:
        cell = to_json_text(f) if isinstance(f.dataType, OPAQUE_TYPES) else ref(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cell = significant(cell, 4)
        elif isinstance(f.dataType, T.BooleanType):
            cell = F.initcap(cell.cast("string"))
        cells.append(F.coalesce(F.substring(cell.cast("string"), 1, 22), F.lit(NO_VALUE)).alias(f.name[:18].replace("`", "")))
    order = [ref(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]
    first = df.orderBy(*order).limit(rows) if order_by else df.limit(rows)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # over `rows` rows
    return first.select(place.cast("string").alias("#"), *cells)


def report_sections(
    raw: DataFrame,
    clean: DataFrame | None,
    history: list[Step] | None = None,
    order_by: list[str] | None = None,
) -> dict[str, DataFrame]:
    """The report as named tables, in report order. An absent or empty cleaned table is
    replaced by the raw one."""
    if clean is None or not clean.columns or clean.isEmpty():
        clean = raw
    measured = compare.measure(raw, clean)
    sections = {
        "1_summary": compare.kpi_deltas(raw, clean, measured),
        "2_quality": compare.quality_improvement(raw, clean, measured),
        "3_comparison": compare.report_comparison(raw, clean, measured),
        "4_schema": profile.report_schema(clean),
        "5_cleaning_log": cleaning_log(raw, history or []),
    }
    if numeric_columns(clean):
        sections["6_statistics"] = report_statistics(clean)
    sections |= {
        "7_preview_before": report_preview(raw, order_by),
        "7_preview_after": report_preview(clean, order_by),
        "8_1_missing": chartdata.missing_per_column(raw),
        "8_2_impact": compare.before_after_counts(raw, clean, measured),
        "8_3_shift": chartdata.distribution_shift(raw, clean),
        "8_4_distributions": chartdata.report_distributions(clean),
        "8_5_correlation": chartdata.correlation_matrix(clean, max_columns=12),
    }
    return sections


def write_report(
    raw: DataFrame,
    clean: DataFrame | None,
    folder: str,
    history: list[Step] | None = None,
    order_by: list[str] | None = None,
    format: str = "parquet",
) -> DataFrame:
    """Write each report table below ``folder`` and return the index: section, path. The
    cleaned table is written out first, as a dozen scans read it."""
    if clean is not None and clean.columns:
        clean = materialize(clean, "report-table")
    index = []
    for name, table in report_sections(raw, clean, history, order_by).items():
        path = f"{folder.rstrip('/')}/{name}"
        table.coalesce(1).write.format(format).save(path)  # tables of report size
        index.append((name, path))
    return stats.small_frame(raw.sparkSession, index, "section string, path string")
