"""Profiles that grow: a table of states, one line per part and column, that new files add to.

A state holds counts, the first four central moments, extremes and two sketches (distinct values,
quantiles). States of parts merge into the state of the whole without reading the parts again: counts and
moments exactly (but for rounding), the sketches within their accuracy. A further line per part, column
``ROWS``, holds whole rows, from which repeated rows are estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import stats
from ..functions.types import numeric_columns, truth_columns
from . import compare, profile

# The ordinal and name of the line of whole rows.
ROWS = "*"
# Relative error of numbers of distinct values, and size of the quantile sketches (rank error some 2.3 / size).
ACCURACY = 0.01
QUANTILE_SIZE = 1_000
SCHEMA = (
    "part string, ordinal int, name string, type string, rows bigint, present bigint, n bigint, mean double, s2 double, s3 double, "
    "s4 double, low double, high double, marks binary, values binary")


def states(df: DataFrame, part: Column | str, accuracy: float = ACCURACY) -> DataFrame:
    """The states of ``df``, by ``part``: a name, or a column such as ``_metadata.file_path``. Cells are
    unpivoted, and each task sends one line per part and column, whatever its rows."""
    part = (F.lit(part) if isinstance(part, str) else part).cast("string")
    numeric = set(numeric_columns(df) + truth_columns(df))
    lines = [F.struct(F.lit(-1).alias("ordinal"), stats.row_mark(df).alias("mark"), F.lit(None).cast("double").alias("number"))]
    for i, f in enumerate(df.schema):
        given = stats.present(df, f.name)
        number = stats.as_number(df, f.name) if f.name in numeric else F.lit(None).cast("double")
        lines.append(F.struct(
            F.lit(i).alias("ordinal"), F.when(given, F.xxhash64(stats.plain_text(f))).alias("mark"), number.alias("number")))
    cells = df.select(part.alias("part"), F.explode(F.array(*lines)).alias("c")).select("part", "c.*")
    n, deviation = F.col("n"), F.col("deviation")
    found = cells.groupBy("part", "ordinal").agg(
        F.count(F.lit(1)).alias("rows"), F.count("mark").alias("present"), F.count("number").alias("n"), F.avg("number").alias("mean"),
        F.stddev_pop("number").alias("deviation"), F.skewness("number").alias("skew"), F.kurtosis("number").alias("kurtosis"),
        F.min("number").alias("low"), F.max("number").alias("high"),
        F.hll_sketch_agg("mark", profile.sketch_size(accuracy)).alias("marks"), F.kll_sketch_agg_double("number", QUANTILE_SIZE).alias("values"))
    names = stats.small_frame(
        df.sparkSession, [(-1, ROWS, "row")] + [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "ordinal int, name string, type string")
    return found.join(F.broadcast(names), "ordinal").select(
        "part", "ordinal", "name", "type", "rows", "present", "n", "mean", (n * deviation * deviation).alias("s2"),
        (n * F.pow(deviation, F.lit(3)) * F.coalesce("skew", F.lit(0.0))).alias("s3"),
        (n * F.pow(deviation, F.lit(4)) * (F.coalesce("kurtosis", F.lit(-3.0)) + 3)).alias("s4"), "low", "high", "marks", "values")


def merged(states: DataFrame, part: str = "all") -> DataFrame:
    """One state per column of all parts together; columns go by name, in the order in which the
    first parts have them. A part without a column counts its rows as missing there."""
    same = Window.partitionBy("name")
    total = F.sum("n").over(same)
    mean = F.sum(F.coalesce(F.col("mean"), F.lit(0.0)) * F.col("n")).over(same)
    d = F.coalesce(F.col("mean") - F.try_divide(mean, total), F.lit(0.0))
    n, s2, s3 = F.col("n"), F.coalesce("s2", F.lit(0.0)), F.coalesce("s3", F.lit(0.0))
    # Moments about the common mean; a window over the parts of a column, one line each.
    moved = states.withColumns({
        "m": F.try_divide(mean, total), "t2": s2 + n * d * d, "t3": s3 + 3 * d * s2 + n * F.pow(d, F.lit(3)),
        "t4": F.coalesce("s4", F.lit(0.0)) + 4 * d * s3 + 6 * d * d * s2 + n * F.pow(d, F.lit(4))})
    joined = moved.groupBy("name").agg(
        F.min("ordinal").alias("ordinal"), F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("mixed").alias("type"),
        F.sum("present").alias("present"), F.sum("n").alias("n"), F.first("m").alias("mean"), F.sum("t2").alias("s2"),
        F.sum("t3").alias("s3"), F.sum("t4").alias("s4"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("marks").alias("marks"), F.kll_merge_agg_double("values").alias("values"))
    rows = states.where(F.col("name") == ROWS).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return joined.crossJoin(F.broadcast(rows)).select(  # one line
        F.lit(part).alias("part"), "ordinal", "name", "type", "rows", *[c.split()[0] for c in SCHEMA.split(", ")[5:]])


def summary(state: DataFrame, digits: int = 4) -> DataFrame:
    """The columns of ``dtype_summary`` and ``numeric_summary``, from merged states; distinct values and
    quartiles are estimates."""
    n = F.col("n").cast("double")
    std = F.sqrt(F.try_divide(F.col("s2"), n - 1))
    m2, varied = F.try_divide(F.col("s2"), n), F.col("s2") > 0
    skew = F.when(varied, F.try_divide(F.col("s3"), n) / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    excess = F.try_divide(F.col("s4"), n) / (m2 * m2) - 3
    kurtosis = F.when(varied, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * excess + 6)).otherwise(0.0)
    numbers = F.col("n") > 0
    quartiles = F.when(numbers, F.kll_sketch_get_quantile_double("values", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    missing = F.col("rows") - F.col("present")
    shown = {
        "count": F.when(numbers, n), "mean": F.col("mean"), "std": std, "min": F.col("low"), "25%": quartiles[0], "50%": quartiles[1],
        "75%": quartiles[2], "max": F.col("high"), "skewness": F.when(F.col("n") >= 3, skew), "kurtosis": F.when(F.col("n") >= 4, kurtosis)}
    return state.where(F.col("name") != ROWS).orderBy("ordinal", "name").select(
        F.col("name").alias("Column"), F.col("type").alias("Data Type"), F.col("present").alias("Non-Null Count"),
        missing.alias("Missing Count"),
        F.round(F.coalesce(F.try_divide(missing.cast("double"), F.col("rows")) * 100, F.lit(0.0)), 2).alias("Missing %"),
        F.coalesce(F.hll_sketch_estimate("marks"), F.lit(0)).alias("Unique Values"),
        *[F.round(c, digits).alias(name) for name, c in shown.items()])


def metrics(state: DataFrame) -> DataFrame:
    """rows, cols, missing and duplicates (estimated) of merged states, as ``basic_metrics`` has them."""
    row = F.col("name") == ROWS
    distinct = F.max(F.when(row, F.hll_sketch_estimate("marks")))
    rows = F.coalesce(F.max(F.when(row, F.col("rows"))), F.lit(0))
    return state.agg(
        rows.alias("rows"), F.count_if(~row).alias("cols"),
        F.coalesce(F.sum(F.when(~row, F.col("rows") - F.col("present"))), F.lit(0)).alias("missing"),
        F.greatest(rows - F.coalesce(distinct, F.lit(0)), F.lit(0)).alias("duplicates"))


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric, Before, After of two merged states, as ``compare.before_after`` has them for tables."""
    return compare.comparison_of(metrics(before), metrics(after))


class ProfileStore:
    """States in one folder. ``add`` reads only what is new."""

    def __init__(self, spark: SparkSession, path: str, accuracy: float = ACCURACY):
        self.spark, self.path, self.accuracy = spark, path, accuracy
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def states(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def add(self, df: DataFrame, part: str) -> bool:
        """Adds a table under a name; False if there is such a part already."""
        if not self.states().where(F.col("part") == part).isEmpty():
            return False
        states(df, part, self.accuracy).coalesce(1).write.mode("append").parquet(self.path)
        return True

    def merged(self) -> DataFrame:
        return merged(self.states())
