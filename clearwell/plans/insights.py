"""The most telling facts about a table: distributions, correlations, categories and a
trend, each with a score."""

from math import log1p

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import stats
from ..functions.correlation import correlations, pearson
from ..functions.types import (
    date_like_columns,
    is_id_like,
    numeric_columns,
    other_columns,
    ref,
)
from ..operators.columns import column_as_datetime, dealt_dates

SCHEMA = (
    "position int, type string, title string, description string, "
    "score double, columns array<string>"
)
# Thresholds and limits.
MIN_CORRELATION = 0.4
MIN_TREND = 0.3
TOP_SHARE_RANGE = (0.1, 0.95)
MAX_INSIGHTS = 4
MAX_PER_TYPE = 2
# Text that stands for NULL among the categories.
MISSING_CATEGORY = "nan"
# What an insight tells, in short and in full.
DISTRIBUTION_TITLE = "Distribution of {c} ({side})"
DISTRIBUTION = "Column `{c}` shows a {side} distribution indicating potential outliers."
DISTRIBUTION_FULL = (
    "Column `{c}` shows a {side} distribution with noticeable variance, indicating potential outliers or long tails."
)
CORRELATION_TITLE = "{a} and {b} are {sign} correlated"
CORRELATION = "Features `{a}` and `{b}` have a correlation of {r:.2f}."
CORRELATION_FULL = (
    "Features `{a}` and `{b}` have a correlation of {r:.2f}, suggesting a meaningful linear relationship."
)
CATEGORY_TITLE = "Top categories in `{c}`"
CATEGORY_TITLE_FEW = "Category split in `{c}`"
CATEGORY = "Column `{c}` is dominated by `{value}` ({share:.1f}%)."
CATEGORY_FULL = (
    "Column `{c}` is dominated by value `{value}` ({share:.1f}% of records). "
    "Top 5 categories together cover about {leading:.1f}% of the dataset."
)
TREND_TITLE = "Trend of `{c}` over `{date}`"
TREND = "Average value of `{c}` appears to be {way}."
TREND_FULL = (
    "Over time, the average value of `{c}` appears to be {way}, with a trend strength of about {r:.2f}."
)


def _frame(df: DataFrame, rows: list) -> DataFrame:
    return stats.small_frame(
        df.sparkSession, [(i, *r) for i, r in enumerate(rows)], SCHEMA
    ).orderBy("position")


# --------------------------------------------------------------------------- #
# distributions and correlations
# --------------------------------------------------------------------------- #


def _distribution_rows(df, full, found=None):
    columns = [c for c in numeric_columns(df) if not is_id_like(c)]
    found = found or stats.moments(df, columns, shape=True)
    told = [(c, found.columns[c]) for c in columns]
    told = [(c, m, "right-skewed" if m.skew > 0 else "left-skewed") for c, m in told if m.variance and m.skew is not None]
    text = DISTRIBUTION_FULL if full else DISTRIBUTION
    return [
        ("distribution", DISTRIBUTION_TITLE.format(c=c, side=side), text.format(c=c, side=side),
         abs(m.skew) * 0.5 + log1p(m.variance), [c])
        for c, m, side in told
    ]


def distribution_insights(df: DataFrame, full: bool = False) -> DataFrame:
    return _frame(df, _distribution_rows(df, full))


def _correlation_rows(df, full):
    text = CORRELATION_FULL if full else CORRELATION
    strong = [
        (pair, r) for pair, r in correlations(df, numeric_columns(df)).items()
        if r is not None and abs(r) >= MIN_CORRELATION
    ]
    return [
        ("correlation",
         CORRELATION_TITLE.format(a=a, b=b, sign="positively" if r > 0 else "negatively"),
         text.format(a=a, b=b, r=r), abs(r) * 2.0, [a, b])
        for (a, b), r in strong
    ]


def correlation_insights(df: DataFrame, full: bool = False) -> DataFrame:
    return _frame(df, _correlation_rows(df, full))


# --------------------------------------------------------------------------- #
# categories
# --------------------------------------------------------------------------- #


def as_category(df: DataFrame, name: str) -> Column:
    """The text under which a cell is counted; NULL has a text of its own."""
    text = ref(name).cast("string")
    if isinstance(df.schema[name].dataType, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit(MISSING_CATEGORY))


# Characters by which categories of equal counts are put in order before whole texts are.
HEAD = 256


def leading_categories(
    df: DataFrame, columns: list[str], top: int = 5, count_missing: bool = True
) -> DataFrame:
    """Per column: total, number of categories, the leading value's first ``HEAD``
    characters, its count and the count of the ``top`` values. Long text is counted by
    digest beside its head. Ranks are cut per task before the shuffle, so no column's values
    gather in one place."""
    cells = []
    for c in columns:
        cell = as_category(df, c) if count_missing else ref(c).cast("string")
        cells.append([stats.digest(cell), F.substring(cell, 1, HEAD)])
    counts = (
        stats.unpivot(df, cells, ["ordinal", "mark", "head"])
        .where(F.col("mark").isNotNull())
        .groupBy("ordinal", "mark")
        .agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("head"))
    )
    totals = counts.groupBy("ordinal").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("categories")
    )
    order = Window.partitionBy("ordinal").orderBy(F.desc("n"), "head", "mark")
    leaders = (
        counts.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .groupBy("ordinal")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("head"))).alias("value"),
            F.max("n").alias("first"),
            F.sum("n").alias("leading"),
        )
    )
    # One row per column on both sides.
    return leaders.join(F.broadcast(totals), "ordinal")


def _whole_text(df, name, head):
    """The commonest text that begins with ``head``, of equally common ones the first."""
    if len(head) < HEAD:
        return head
    cell = as_category(df, name)
    row = (
        df.select(cell.alias("v")).where(F.substring("v", 1, HEAD) == head)
        .groupBy(F.sha2("v", 256)).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        .orderBy(F.desc("n"), "v").first()
    )
    return row["v"]


def _category_rows(df, full, count_missing=True):
    columns = other_columns(df)
    if not columns:
        return []
    low, high = TOP_SHARE_RANGE
    found = leading_categories(df, columns, count_missing=count_missing)
    share, text = F.col("first") / F.col("total"), CATEGORY_FULL if full else CATEGORY
    rows = []
    for r in found.where(share.between(low, high)).orderBy("ordinal").collect():  # one row per column
        c, leading = columns[r["ordinal"]], r["leading"] / r["total"]
        title = CATEGORY_TITLE_FEW if full and r["categories"] <= 2 else CATEGORY_TITLE
        told = text.format(
            c=c, value=_whole_text(df, c, r["value"]), share=r["first"] / r["total"] * 100, leading=leading * 100)
        rows.append(("category", title.format(c=c), told, leading * 0.8, [c]))
    return rows


def category_insights(
    df: DataFrame, full: bool = False, count_missing: bool = True
) -> DataFrame:
    return _frame(df, _category_rows(df, full, count_missing))


# --------------------------------------------------------------------------- #
# trend
# --------------------------------------------------------------------------- #


def daily_means(
    df: DataFrame, date_column: str, value_column: str, when: Column | None = None
) -> DataFrame:
    """(day, mean) for the days that hold a value, unordered. ``when``: the date column as a time,
    if it is known already."""
    if when is None:
        df = dealt_dates(df, date_column)
        when = column_as_datetime(df, date_column)
    return (
        df.select(F.to_date(when).alias("day"), ref(value_column).cast("double").alias("value"))
        .where(F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.avg("value").alias("mean"))
        .where(F.col("mean").isNotNull())
    )


def _trend_rows(df, full):
    dates = date_like_columns(df)
    if not dates:
        return []
    date = dates[0]
    df = dealt_dates(df, date)
    when = column_as_datetime(df, date)
    dated = df.where(when.isNotNull())
    columns = [c for c in numeric_columns(df) if c != date]
    if not columns:
        return []
    found = stats.moments(dated, columns).columns
    target = max(columns, key=lambda c: -1.0 if found[c].variance is None else found[c].variance)
    # At most one row per calendar day reaches this window.
    days = daily_means(df, date, target, when).withColumn(
        "x", F.row_number().over(Window.orderBy("day")).cast("double")
    )
    row = days.agg(
        F.count("mean").alias("n"), pearson(F.col("x"), F.col("mean")).alias("r")
    ).first()
    r = row["r"]
    if row["n"] < 3 or r is None or abs(r) < MIN_TREND:
        return []
    way, text = "increasing" if r > 0 else "decreasing", TREND_FULL if full else TREND
    title = TREND_TITLE.format(c=target, date=date)
    return [("trend", title, text.format(c=target, way=way, r=r), abs(r) * 2.0, [date, target])]


def trend_insights(df: DataFrame, full: bool = False) -> DataFrame:
    return _frame(df, _trend_rows(df, full))


# --------------------------------------------------------------------------- #
# selection
# --------------------------------------------------------------------------- #


def top_insights(df: DataFrame, full: bool = False) -> DataFrame:
    """The best four by score, at most two of a type; earlier finds win ties."""
    rows = []
    if df.columns:
        rows += _distribution_rows(df, full)
        rows += _correlation_rows(df, full)
        rows += _category_rows(df, full)
        rows += _trend_rows(df, full)
    best = (F.desc("score"), "position")
    # Windows over one row per find.
    within = F.row_number().over(Window.partitionBy("type").orderBy(*best))
    chosen = _frame(df, rows).withColumn("place", within).where(F.col("place") <= MAX_PER_TYPE)
    chosen = chosen.orderBy(*best).limit(MAX_INSIGHTS)
    place = F.row_number().over(Window.orderBy(*best)) - 1
    return chosen.select(
        place.alias("position"), *[c for c in chosen.columns if c not in ("position", "place")]
    ).orderBy("position")
