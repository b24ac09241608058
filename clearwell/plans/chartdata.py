"""The series behind the charts and the report figures, as small DataFrames."""

from pyspark.sql import DataFrame, functions as F

from ..functions import stats
from ..functions.correlation import correlations
from ..functions.types import is_id_like, numeric_columns, ref
from . import insights


def missing_per_column(df: DataFrame) -> DataFrame:
    """Column, Missing: the columns with NULL cells, in column order."""
    wide = df.agg(
        *[F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    parts = [
        F.struct(F.lit(c).alias("Column"), F.col(f"m{i}").alias("Missing"))
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*parts))).where(F.col("Missing") > 0)


def _drawn(df: DataFrame, rows: int, key: list[str] | None, seed: int) -> DataFrame:
    """A uniform sample of fixed size by top-k. With a ``key`` the draw depends on the
    key values alone, not on the file layout."""
    if key:
        draw = F.md5(F.concat_ws("|", *[ref(c).cast("string") for c in key]))
    else:
        draw = F.rand(seed)
    return df.withColumn("__draw", draw).orderBy("__draw").limit(rows).drop("__draw")


def missing_matrix(
    df: DataFrame, rows: int = 200, key: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """1 for a NULL cell, 0 otherwise, on sampled rows; empty when nothing is missing."""
    _, nulls = stats.null_counts(df, df.columns)
    if not any(nulls.values()):
        df = df.where(F.lit(False))
    return _drawn(df, rows, key, seed).select(
        *[ref(c).isNull().cast("int").alias(c) for c in df.columns]
    )


def correlation_matrix(
    df: DataFrame, max_columns: int | None = None, digits: int = 2
) -> DataFrame:
    """x, y, r for every ordered pair of numeric columns, the diagonal included; r is
    NULL where a column is constant. Fewer than two columns give no rows."""
    columns = numeric_columns(df)[:max_columns]
    if len(columns) < 2:
        return stats.small_frame(df.sparkSession, [], "x string, y string, r double")
    summary = stats.moments(df, columns)
    found = correlations(df, columns)
    constant = {c for c, m in summary.columns.items() if not m.n or m.constant}
    rows = []
    for a in columns:
        for b in columns:
            if a == b:
                rows.append((a, b, None if a in constant else 1.0))
            else:
                rows.append((a, b, found[(a, b)] if (a, b) in found else found[(b, a)]))
    frame = stats.small_frame(df.sparkSession, rows, "x string, y string, r double")
    # Adding zero turns a rounded -0.0 into 0.0.
    return frame.withColumn("r", F.round("r", digits) + F.lit(0.0))


def widest_columns(df: DataFrame, top: int) -> list[str]:
    """Numeric columns by falling variance."""
    columns = numeric_columns(df)
    found = stats.moments(df, columns).columns if columns else {}
    spread = {c: -1.0 if m.variance is None else m.variance for c, m in found.items()}
    return sorted(columns, key=lambda c: -spread[c])[:top]


def histogram(
    df: DataFrame, columns: list[str], bins: int, lines: bool = False
) -> DataFrame:
    """column, bin, lo, hi, count with equal-width bins over each column's own range,
    the last one closed. ``lines`` adds mean and median. Empty bins count 0."""
    found = stats.moments(df, columns) if columns else stats.TableMoments(0)
    columns = [c for c in columns if found.columns[c].n]
    extra = ", mean double, median double" if lines else ""
    schema = f"column string, bin int, lo double, hi double{extra}"
    medians = {}
    if lines:
        medians = stats.quantiles(df, columns, [0.5], summary=found)
    frame, cells = [], [F.lit(max(len(columns), 1))]
    for c in columns:
        m = found.columns[c]
        low, high = (m.low, m.high) if m.low != m.high else (m.low - 0.5, m.high + 0.5)
        width = (high - low) / bins
        for b in range(bins):
            row = (c, b, low + b * width, high if b == bins - 1 else low + (b + 1) * width)
            frame.append((*row, m.mean, medians[c][0]) if lines else row)
        value = ref(c).cast("double")
        place = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
        cells += [F.lit(c), F.when(value.isNotNull(), place)]
    edges = stats.small_frame(df.sparkSession, frame, schema)
    if not columns:
        return edges.withColumn("count", F.lit(0).cast("bigint"))
    counted = (
        df.select(F.stack(*cells).alias("column", "bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most columns * bins rows.
    return (
        edges.join(F.broadcast(counted), ["column", "bin"], "left")
        .withColumn("count", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


def distributions(df: DataFrame, top: int = 3, bins: int = 30) -> DataFrame:
    """Histograms of the columns that vary most."""
    return histogram(df, widest_columns(df, top), bins)


def report_distributions(df: DataFrame, top: int = 4, bins: int = 25) -> DataFrame:
    return histogram(df, widest_columns(df, top), bins, lines=True)


def insight_distribution(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Histogram with mean and median of one column; id-like columns are skipped."""
    skip = is_id_like(column) or column not in df.columns
    return histogram(df, [] if skip else [column], bins, lines=True)


def distribution_shift(raw: DataFrame, clean: DataFrame, bins: int = 30) -> DataFrame:
    """First numeric column common to both versions, each on its own range."""
    after = numeric_columns(clean)
    common = [c for c in numeric_columns(raw) if c in after][:1]
    parts = [
        histogram(df, common, bins).select(F.lit(v).alias("version"), "*")
        for v, df in (("Before", raw), ("After", clean))
    ]
    return parts[0].unionByName(parts[1])


def box_statistics(raw: DataFrame, clean: DataFrame, column: str) -> DataFrame:
    """Per version: quartiles, whiskers (last values within 1.5 interquartile ranges),
    mean and population standard deviation."""
    parts = []
    for version, df in (("Before", raw), ("After", clean)):
        q1, median, q3 = stats.quantiles(df, [column], [0.25, 0.5, 0.75])[column]
        value = ref(column).cast("double")
        if q1 is None:
            low_side = high_side = F.lit(None).cast("double")
        else:
            reach = 1.5 * (q3 - q1)
            low_side = F.min(F.when(value >= q1 - reach, value))
            high_side = F.max(F.when(value <= q3 + reach, value))
        parts.append(
            df.agg(
                F.lit(version).alias("version"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(median).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"),
                low_side.alias("whisker_low"),
                high_side.alias("whisker_high"),
                F.avg(value).alias("mean"),
                F.stddev_pop(value).alias("sd"),
            )
        )
    return parts[0].unionByName(parts[1])


def top_categories(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """value, count of the commonest values; a top-k over the grouped counts."""
    return (
        df.groupBy(insights.as_category(df, column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(top)
    )


def proportions(df: DataFrame, column: str, top: int = 8) -> DataFrame:
    """value, count and share among the values shown."""
    leading = top_categories(df, column, top)
    total = leading.agg(F.sum("count")).first()[0]
    return leading.withColumn("share", F.col("count") / F.lit(total or 1))


def daily_series(df: DataFrame, date_column: str, value_column: str) -> DataFrame:
    """day, mean in day order, for the days that hold a value. Rows without a value
    never change a mean, so dropping them first or last is the same."""
    return insights.daily_means(df, date_column, value_column).orderBy("day")


def scatter_sample(
    df: DataFrame, x: str, y: str, rows: int = 3_000, key: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """Complete pairs, sampled down to ``rows`` points."""
    complete = df.na.drop("any", subset=[x, y])
    return _drawn(complete, rows, key, seed).select(ref(x).alias("x"), ref(y).alias("y"))
