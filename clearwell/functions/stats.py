"""The three tables every analysis shares: value counts, moments and quantiles.

Each is one aggregation with map-side combine. What reaches the driver is a few
numbers per column, never rows.
"""

from dataclasses import dataclass, field
from math import ceil, floor, isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .exprs import any_of, nan_to_null, total_of
from .storage import materialize
from .types import OPAQUE_TYPES, ref

# Text beyond this many characters is counted by its SHA-256 digest.
LONG_TEXT = 64
# Columns unpivoted by one plan node, and plain counts in one aggregate.
COLUMNS_PER_PASS = 64
COUNTS_PER_PASS = 100
# Aggregate functions side by side that the JVM still compiles.
COMPILED_AGGREGATES = 33
# Cells whose distinct values may be sorted to finish exact quantiles.
SORTED_CELLS = 100_000
# Equal-width bins of a column's range, counted first.
BINS = 1_024
# Rank error of one quantile sketch is rows / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000


_ARROW_TYPES = {
    "boolean": pa.bool_(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
    "array<int>": pa.list_(pa.int32()),
}


def small_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A frame of a few driver-side rows (one per column, rule or step). By way of Arrow
    it becomes a local relation, which is read without a job."""
    fields = T.StructType.fromDDL(schema)
    cells = list(zip(*rows)) or [[] for _ in fields]
    table = pa.table(
        [pa.array(c, _ARROW_TYPES[f.dataType.simpleString()]) for c, f in zip(cells, fields)],
        names=[f.name for f in fields],
    )
    return spark.createDataFrame(table, fields)


# --------------------------------------------------------------------------- #
# value counts
# --------------------------------------------------------------------------- #


def digest(col: Column) -> Column:
    """Long text as its SHA-256, other text as it is."""
    return F.when(
        F.length(col) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(col, 256))
    ).otherwise(col)


SLOTS = ("whole", "fraction", "exact", "text")


def exact_type(df: DataFrame, columns: list[str]) -> T.DecimalType | None:
    """A decimal type that holds every decimal column's values; None if no type does."""
    kinds = [df.schema[c].dataType for c in columns if isinstance(df.schema[c].dataType, T.DecimalType)]
    whole = max((k.precision - k.scale for k in kinds), default=1)
    places = max((k.scale for k in kinds), default=0)
    return T.DecimalType(whole + places, places) if whole + places <= 38 else None


def _typed(field: T.StructField, shorten: bool, exact: T.DecimalType | None) -> list[Column]:
    """The ``SLOTS`` of a cell, with the one that fits the type set."""
    col, slots = ref(field.name), dict.fromkeys(SLOTS)
    if isinstance(field.dataType, T.IntegralType):
        slots["whole"] = col.cast("bigint")
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        slots["fraction"] = F.when(~F.isnan(col), col.cast("double"))
    elif isinstance(field.dataType, T.DecimalType) and exact:
        slots["exact"] = col.cast(exact)
    elif isinstance(field.dataType, T.StringType):
        slots["text"] = digest(col) if shorten else col
    elif isinstance(field.dataType, OPAQUE_TYPES):
        slots["text"] = F.sha2(_opaque_text(field), 256)
    else:
        slots["text"] = col.cast("string")
    kinds = dict(zip(SLOTS, ("bigint", "double", exact or "bigint", "string")))
    return [F.lit(None).cast(kinds[n]) if c is None else c for n, c in slots.items()]


def _opaque_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(ref(field.name))
    return F.to_json(ref(field.name))


def unpivot(df: DataFrame, cells: list[list[Column]], names: list[str]) -> DataFrame:
    """One row per table row and column: the column's ordinal and its cell. Aggregating
    this form takes one scan and generated code of one size, however wide the table;
    one wide aggregate outgrows what the JVM compiles after some thirty functions."""
    parts = []
    for start in range(0, len(cells), COLUMNS_PER_PASS):
        batch = cells[start : start + COLUMNS_PER_PASS]
        flat = [F.lit(len(batch))]
        for i, cell in enumerate(batch, start):
            flat += [F.lit(i), *cell]
        parts.append(df.select(F.stack(*flat).alias(*names)))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionAll(part)
    return long


def value_counts(df: DataFrame, columns: list[str], shorten: bool = False) -> DataFrame:
    """``(ordinal, whole, fraction, exact, text, n)``: how often each value occurs in each
    column, from one scan and one exchange. Values keep their type class, so ties
    compare as numbers. ``shorten`` swaps long text for its digest, for callers
    that only count distinct values."""
    fields = {f.name: f for f in df.schema}
    exact = exact_type(df, columns)
    long = unpivot(df, [_typed(fields[name], shorten, exact) for name in columns], ["ordinal", *SLOTS])
    return long.groupBy("ordinal", *SLOTS).agg(
        F.count(F.lit(1)).alias("n")
    )


def has_value() -> Column:
    """Whether a value-count row stands for a value rather than for NULL."""
    return F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("fraction").isNotNull() | F.col("exact").isNotNull()


# --------------------------------------------------------------------------- #
# whole rows
# --------------------------------------------------------------------------- #


# Columns up to which a row is grouped as it stands; a wider one travels as its digest.
NARROW_ROW = 4


def grouped_rows(df: DataFrame, facts: list[Column] | None = None) -> DataFrame:
    """Distinct rows with their number of copies ``__n`` and the named ``facts`` about them.
    Wide rows and long text are grouped by a SHA-256 of all cells, so some 40 bytes a row
    travel, whatever its width; hot copies combine before the shuffle."""
    df = nan_to_null(df)
    facts = facts or []
    if len(df.columns) <= NARROW_ROW and not any(isinstance(f.dataType, (T.StringType, *OPAQUE_TYPES)) for f in df.schema):
        keys = [ref(c).alias(f"__k{i}") for i, c in enumerate(df.columns)] or [F.lit(0).alias("__k0")]
    else:
        keys = [F.unhex(F.sha2(_row_text(df), 256)).alias("__k0")]
    # Facts are the same for equal rows, so they may stand beside the key.
    return (
        df.select(*keys, *facts)
        .groupBy(*[f"__k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in df.select(*facts).columns])
    )


def _row_text(df: DataFrame) -> Column:
    """A text that is the same for equal rows only."""
    cells = [F.concat(F.octet_length(text).cast("string"), F.lit(":"), text) for text in map(plain_text, df.schema)]
    return F.concat_ws(",", *[F.coalesce(c, F.lit("-")) for c in cells])


def row_mark(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row."""
    return F.xxhash64(_row_text(df))


def plain_text(field: T.StructField) -> Column:
    """A text that is the same for equal cells only; NULL for NULL."""
    return _opaque_text(field) if isinstance(field.dataType, OPAQUE_TYPES) else _plain_text(field)


def _plain_text(field: T.StructField) -> Column:
    col = ref(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        col = F.when(col == 0, F.lit(0.0)).otherwise(col)  # -0.0 equals 0.0
    return col.cast("string")


def present(df: DataFrame, name: str) -> Column:
    """Whether a cell holds a value; NaN is none."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return ref(name).isNotNull() & ~F.isnan(ref(name))
    return ref(name).isNotNull()


def null_cells(df: DataFrame) -> Column:
    return total_of((~present(df, c)).cast("int") for c in df.columns).cast("bigint")


# --------------------------------------------------------------------------- #
# moments
# --------------------------------------------------------------------------- #


@dataclass
class Moments:
    """Per-column summary; ``n`` counts non-NULL cells."""

    n: int = 0
    mean: float | None = None
    deviation: float | None = None
    low: float | None = None
    high: float | None = None
    skew: float | None = None
    kurtosis: float | None = None

    @property
    def constant(self) -> bool:
        return self.n > 0 and self.low == self.high

    @property
    def variance(self) -> float | None:
        """Sample variance; the deviation is that of the population."""
        return self.deviation**2 * self.n / (self.n - 1) if self.n > 1 else None


@dataclass
class TableMoments:
    rows: int
    columns: dict[str, Moments] = field(default_factory=dict)


def skew_of(col: Column) -> Column:
    """Bias-corrected skewness G1; 0 for a constant column, NULL below 3 values."""
    n = F.count(col).cast("double")
    scale = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(F.skewness(col) * scale, F.lit(0.0)))


def kurtosis_of(col: Column) -> Column:
    """Bias-corrected excess kurtosis G2; 0 for a constant column, NULL below 4 values."""
    n = F.count(col).cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(scale * ((n + 1) * F.kurtosis(col) + 6), F.lit(0.0)))


def as_number(df: DataFrame, name: str) -> Column:
    """A cell as double; NaN is a missing cell."""
    number = ref(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(number), number)
    return number


def moments(df: DataFrame, columns: list[str], shape: bool = False) -> TableMoments:
    """Summary of all columns in one scan; ``shape`` adds skewness and kurtosis."""
    if not columns:
        return TableMoments(df.count())
    aggs = {
        "rows": lambda _: F.count(F.lit(1)),
        "n": F.count,
        "mean": F.avg,
        "deviation": F.stddev_pop,
        "low": F.min,
        "high": F.max,
    }
    if shape:
        aggs |= {"skew": skew_of, "kurtosis": kurtosis_of}
    result = TableMoments(0, {c: Moments() for c in columns})
    found = _per_column(df, [as_number(df, c) for c in columns], aggs)
    for name, values in zip(columns, found):
        if values:
            result.rows = values.pop("rows")
            result.columns[name] = Moments(**values)
    return result


def _per_column(df: DataFrame, cells: list[Column], aggs: dict) -> list[dict]:
    """The same aggregates of several columns, from one scan: side by side while the JVM
    compiles the generated code, else over the unpivoted table, where empty input gives
    empty dicts."""
    if len(cells) * len(aggs) <= COMPILED_AGGREGATES:
        row = df.agg(*[make(cell) for cell in cells for make in aggs.values()]).first()
        return [dict(zip(aggs, values)) for values in batches(list(row), len(aggs))]
    made = [make(F.col("value")).alias(name) for name, make in aggs.items()]
    long = unpivot(df, [[c] for c in cells], ["ordinal", "value"])
    found: list[dict] = [{} for _ in cells]
    for row in long.groupBy("ordinal").agg(*made).collect():  # one row per column
        values = row.asDict()
        found[values.pop("ordinal")] = values
    return found


def null_counts(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of the table and NULL cells per column."""
    rows, nulls = None, {}
    for batch in batches(columns, COUNTS_PER_PASS):
        row = df.agg(F.count(F.lit(1)), *[F.count(F.when(present(df, c), 1)) for c in batch]).first()
        rows = row[0]
        nulls |= {c: rows - n for c, n in zip(batch, row[1:])}
    return df.count() if rows is None else rows, nulls


def batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


# --------------------------------------------------------------------------- #
# quantiles
# --------------------------------------------------------------------------- #


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    accuracy: int | None = None,
    summary: TableMoments | None = None,
    sorted_cells: int = SORTED_CELLS,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column, NULL cells left out.

    Exact by default, without the built-in ``percentile``, which keeps every distinct
    value in one buffer: the wanted ranks are located in counts per value range, and
    only the ranges that hold one are sorted. ``accuracy`` asks for one sketch per
    column instead. ``summary`` saves a scan when moments are known.
    """
    if not columns:
        return {}
    data = df.select([as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = data.columns
    if accuracy:
        row = data.agg(
            *[F.percentile_approx(c, probabilities, accuracy).alias(c) for c in names]
        ).first()
        return {c: row[n] or [None] * len(probabilities) for c, n in zip(columns, names)}
    if summary is None:
        spans = _spans(data)
    else:
        spans = {n: summary.columns[c] for c, n in zip(columns, names)}
    found = _order_statistics(data, spans, probabilities, sorted_cells)
    result = {}
    for c, n in zip(columns, names):
        values = []
        for p in probabilities:
            if not spans[n].n:
                values.append(None)
                continue
            position = p * (spans[n].n - 1)
            low, high = found[n, floor(position)], found[n, ceil(position)]
            values.append(low + (high - low) * (position - floor(position)))
        result[c] = values
    return result


def spans(df: DataFrame, columns: list[str]) -> TableMoments:
    """Count, least and greatest value only: three aggregates a column."""
    data = df.select([as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    return TableMoments(0, dict(zip(columns, _spans(data).values())))


def _spans(data: DataFrame) -> dict[str, Moments]:
    """Count, least and greatest value of each column."""
    aggs = {"n": F.count, "low": F.min, "high": F.max}
    found = _per_column(data, [F.col(c) for c in data.columns], aggs)
    return {c: Moments(**values) for c, values in zip(data.columns, found)}


@dataclass(frozen=True)
class _Interval:
    """Values of a column in one bin, if ``bin`` = (base, scale, index) is set, and
    strictly between ``low`` and ``high``, where those are set."""

    column: str
    bin: tuple | None = None
    low: float | None = None
    high: float | None = None

    def test(self) -> Column:
        col = F.col(self.column)
        test = col.isNotNull()
        if self.bin:
            base, scale, index = self.bin
            test = test & (_bin(col, base, scale) == index)
        if self.low is not None:
            test = test & (col > self.low)
        if self.high is not None:
            test = test & (col < self.high)
        return test


def _bin(col: Column, base: float, scale: float) -> Column:
    """Bin number; never falls as the value rises, whatever the rounding."""
    return F.floor((col - base) * scale)


@dataclass
class _Bracket:
    """A wanted rank, counted from the start of an interval that holds ``size`` values."""

    key: tuple
    rank: int
    size: int
    interval: _Interval


def _order_statistics(data, spans, probabilities, sorted_cells):
    """Values at the ranks around each probability, exactly.

    Equal-width bins are counted first, in one cheap scan. Where values crowd into few
    bins, rounds follow that cut an interval around each rank at two values proposed
    by a sketch and count exactly what lies between and on them: copies of a cut
    point are counted, never kept, so a value that fills a third of the table ends
    its search at once, and other intervals shrink to some 4 / SKETCH_ACCURACY.
    """
    found, open_ = {}, []
    for c, span in spans.items():
        ranks = set()
        for p in probabilities if span.n else []:
            ranks |= {floor(p * (span.n - 1)), ceil(p * (span.n - 1))}
        if span.low == span.high:
            found.update({(c, r): span.low for r in ranks})
        else:
            open_ += [_Bracket((c, r), r, span.n, _Interval(c)) for r in sorted(ranks)]
    rounds = 0
    while sum({b.interval: b.size for b in open_}.values()) > sorted_cells:
        if rounds == 1:
            # Later rounds read only rows that can still matter.
            keep = any_of(i.test() for i in {b.interval for b in open_})
            data = materialize(data.where(keep), "quantile-rows")
        open_ = (_narrow if rounds else _locate_bins)(data, open_, found, spans)
        rounds += 1
    if open_:
        _sort_intervals(data, open_, found)
    return found


def _locate_bins(data, open_, found, spans):
    """Move each bracket into the equal-width bin that holds its rank; a bin with one
    distinct value is an answer."""
    scales = {}
    for c in {b.interval.column for b in open_}:
        width = spans[c].high - spans[c].low
        if isfinite(width) and isfinite(BINS / width):
            scales[c] = (spans[c].low, BINS / width)
    if not scales:
        return open_
    names = sorted(scales)
    cells = [[_bin(F.col(c), *scales[c]), F.col(c)] for c in names]
    counted = (
        unpivot(data, cells, ["ordinal", "bin", "value"])
        .where(F.col("bin").isNotNull())
        .groupBy("ordinal", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()  # at most BINS + 1 rows per column
    )
    bins = {c: [] for c in names}
    for r in sorted(counted, key=lambda r: r["bin"]):
        bins[names[r["ordinal"]]].append(r)
    still = []
    for b in open_:
        rank, c = b.rank, b.interval.column
        for r in bins.get(c, ()):
            if rank >= r["n"]:
                rank -= r["n"]
                continue
            if r["low"] == r["high"]:
                found[b.key] = r["low"]
            else:
                b = _Bracket(b.key, rank, r["n"], _Interval(c, (*scales[c], r["bin"])))
            break
        if b.key not in found:
            still.append(b)
    return still


def _sort_intervals(data, open_, found):
    """Look up ranks in the running count over the sorted distinct values."""
    intervals = {}
    for b in open_:
        intervals.setdefault(b.interval, []).append(b)
    parts = {interval: i for i, interval in enumerate(intervals)}
    cells, hit = [], F.lit(False)
    for c in sorted({i.column for i in intervals}):
        part = F.lit(None).cast("int")
        for interval, i in parts.items():
            if interval.column == c:
                part = F.when(interval.test(), i).otherwise(part)
        cells.append([part, F.col(c)])
    end, start = F.col("end"), F.col("end") - F.col("n")
    for interval, members in intervals.items():
        place = any_of((start <= r) & (end > r) for r in sorted({b.rank for b in members}))
        hit = hit | ((F.col("part") == parts[interval]) & place)
    upto = Window.partitionBy("part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    hits = (
        unpivot(data, cells, ["ordinal", "part", "value"])
        .where(F.col("part").isNotNull())
        .groupBy("part", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("end", F.sum("n").over(upto))
        .where(hit)
        .collect()  # at most one row per wanted rank
    )
    for interval, members in intervals.items():
        for b in members:
            for row in hits:
                if row["part"] == parts[interval] and row["end"] - row["n"] <= b.rank < row["end"]:
                    found[b.key] = row["value"]


def _narrow(data, open_, found, spans):
    """One round: put answers that fell on a cut point into ``found``, return the rest
    with smaller intervals."""
    groups = {}
    for b in open_:
        groups.setdefault(b.interval, []).append(b)
    edges = _propose_cuts(data, groups)
    cells = [
        [F.when(i.test(), _segment(F.col(i.column), edges[i], 0))] for i in groups
    ]
    counted = (
        unpivot(data, cells, ["ordinal", "segment"])
        .where(F.col("segment").isNotNull())
        .groupBy("ordinal", "segment")
        .count()
        .collect()  # two rows per cut point
    )
    sizes = {(r["ordinal"], r["segment"]): r["count"] for r in counted}
    still = []
    for g, (interval, members) in enumerate(groups.items()):
        marks = edges[interval]
        for b in members:
            rank = b.rank
            for segment in range(2 * len(marks) + 1):
                size = sizes.get((g, segment), 0)
                if rank >= size:
                    rank -= size
                    continue
                if segment % 2:
                    found[b.key] = marks[segment // 2]
                else:
                    low = marks[segment // 2 - 1] if segment else interval.low
                    high = marks[segment // 2] if segment < 2 * len(marks) else interval.high
                    inner = _Interval(interval.column, interval.bin, low, high)
                    still.append(_Bracket(b.key, rank, size, inner))
                break
    return still


def _segment(col: Column, edges: list[float], base: int) -> Column:
    """Number of the segment a value falls in: even between edges, odd on an edge."""
    if not edges:
        return F.when(col.isNotNull(), F.lit(base))
    middle = len(edges) // 2
    return (
        F.when(col < edges[middle], _segment(col, edges[:middle], base))
        .when(col == edges[middle], F.lit(base + 2 * middle + 1))
        .otherwise(_segment(col, edges[middle + 1 :], base + 2 * middle + 2))
    )


def _propose_cuts(data, groups):
    """Sorted cut points per interval, two around each wanted rank, from one sketch."""
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for g, (interval, members) in enumerate(groups.items()):
        places = []
        for b in members:
            places.append(max(0.0, b.rank / b.size - margin))
            places.append(min(1.0, (b.rank + 1) / b.size + margin))
        value = F.when(interval.test(), F.col(interval.column))
        sketches.append(F.percentile_approx(value, places, SKETCH_ACCURACY).alias(f"g{g}"))
    row = data.agg(*sketches).first()
    return {interval: sorted(set(row[f"g{g}"])) for g, interval in enumerate(groups)}
