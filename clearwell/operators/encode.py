"""Encoding one column: label codes, codes by first appearance, one-hot columns."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.lookup import BROADCAST_ROWS, SINGLE_TASK_ROWS, join_lookup, number_rows
from ..functions.storage import materialize
from ..functions.types import ref

# Boolean columns that a one-hot encoding adds before it becomes one column; callers
# may set another number.
MAX_COLUMNS = 1_000


@dataclass
class CodeModel:
    """Codes of a column's values as a table (value, n, code), written once. ``transform`` gives any
    table or stream with that column ``<column>_encoded``: a value that the fit has not seen gets
    NULL there, and ``unseen`` tells which these are."""

    column: str
    codes: DataFrame
    rows: int
    total: int
    bytes: int
    missing_label: str | None
    broadcast_rows: int = BROADCAST_ROWS

    @property
    def name(self) -> str:
        return f"{self.column}_encoded"

    def _key(self):
        if self.missing_label is None:
            return ref(self.column)
        return F.coalesce(ref(self.column).cast("string"), F.lit(self.missing_label))

    def _joined(self, df: DataFrame) -> DataFrame:
        return join_lookup(
            df, self._key(), self.codes.withColumnRenamed("code", self.name), "value", "n", self.rows, self.total, self.bytes,
            self.broadcast_rows)

    def transform(self, df: DataFrame) -> DataFrame:
        df = _without(df, self.name, self.column)
        if self.missing_label is not None:
            return self._joined(df)
        kind = self.codes.schema["code"].dataType
        if df.isStreaming:
            # Behind a stream a NULL cell is told by itself, so that it is read once.
            return self._joined(df).withColumn(self.name, F.when(ref(self.column).isNull(), F.lit(-1).cast(kind)).otherwise(ref(self.name)))
        # NULL cells stay out of the join: however many, they are no hot key of it.
        missing = df.where(ref(self.column).isNull()).withColumn(self.name, F.lit(-1).cast(kind))
        return self._joined(df.where(ref(self.column).isNotNull())).unionByName(missing)

    def unseen(self, df: DataFrame) -> DataFrame:
        """value, rows: the values of ``df`` without a code."""
        key = self._key()
        counted = df.where(key.isNotNull()).groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        known = self.codes.select(F.col("value").alias("of"))
        return counted.join(known, F.col("value") == F.col("of"), "left_anti")


def _code_model(values, order, column, missing_label, broadcast_rows, single_task_rows) -> CodeModel:
    """``values`` holds (value, n, ...): written once and numbered in the ``order``."""
    values = materialize(values, "code-values")
    size = values.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("n").alias("total"),
        F.sum(F.octet_length(F.col("value").cast("string")) + 16).alias("bytes"),
    ).first()
    coded = number_rows(values, order, size["rows"], "code", single_task_rows).select("value", "n", "code")
    return CodeModel(column, coded, size["rows"], size["total"] or 0, size["bytes"] or 0, missing_label, broadcast_rows)


def fit_label(
    df: DataFrame,
    column: str,
    missing_label: str = "NA",
    broadcast_rows: int = BROADCAST_ROWS,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> CodeModel:
    """0-based rank of each text among the sorted distinct texts. NULL counts as ``missing_label``,
    which takes its own place in the sort (older behaviour: ``missing_label="None"`` or ``"nan"``)."""
    key = F.coalesce(ref(column).cast("string"), F.lit(missing_label))
    values = df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _code_model(values, ["value"], column, missing_label, broadcast_rows, single_task_rows)


def label_encode(df: DataFrame, column: str, missing_label: str = "NA", **bounds) -> DataFrame:
    """``<column>_encoded`` by ``fit_label`` of the table itself."""
    df = _without(df, f"{column}_encoded", column)
    return fit_label(df, column, missing_label, **bounds).transform(df)


def fit_factorize(
    df: DataFrame,
    column: str,
    order_by: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> CodeModel:
    """Codes by first appearance under ``order_by``; NULL is -1. A Spark table has no order
    of its own, hence the argument."""
    if order_by is None:
        raise ValueError("order_by is needed: codes follow the order of appearance")
    values = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ref(order_by)).alias("first"))
    return _code_model(values, ["first", "value"], column, None, broadcast_rows, single_task_rows)


def factorize(df: DataFrame, column: str, order_by: str | None = None, **bounds) -> DataFrame:
    """``<column>_encoded`` by ``fit_factorize`` of the table itself."""
    df = _without(df, f"{column}_encoded", column, order_by or column)
    return fit_factorize(df, column, order_by, **bounds).transform(df)


def _without(df: DataFrame, name: str, *needed: str) -> DataFrame:
    """``df`` without a column of this name, which is about to be written again."""
    same = [c for c in df.columns if c.lower() == name.lower() and c not in needed]
    return df.select(*[ref(c) for c in df.columns if c not in same])


def _unique_names(wanted: list[str], taken: list[str]) -> list[str]:
    """``wanted`` with _2, _3, .. behind a name that, upper and lower case alike, an earlier
    one or one of ``taken`` has: such columns could not be told apart."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        new, number = name, 1
        while new.lower() in used:
            number += 1
            new = f"{name}_{number}"
        used.add(new.lower())
        out.append(new)
    return out


@dataclass
class OneHotModel:
    """The sorted values of a column that get a boolean column each; None: too many, so that the
    result is one map column. ``transform`` works on any table or stream with that column; an
    unseen value is false everywhere (a map holds it), and ``unseen`` tells which these are."""

    column: str
    values: list | None

    def transform(self, df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != self.column]
        kept = [ref(c) for c in others]
        if self.values is None:
            key = ref(self.column).cast("string")
            empty = F.create_map().cast("map<string,boolean>")
            cell = F.when(key.isNotNull(), F.create_map(key, F.lit(True))).otherwise(empty)
            return df.select(*kept, cell.alias(_unique_names([f"{self.column}_one_hot"], others)[0]))
        names = _unique_names([f"{self.column}_{v}" for v in self.values], others)
        flags = [
            F.coalesce(ref(self.column) == F.lit(v), F.lit(False)).alias(name)
            for v, name in zip(self.values, names)
        ]
        return df.select(*kept, *flags)

    def unseen(self, df: DataFrame) -> DataFrame:
        """value, rows: the values of ``df`` without a column; none if all are in a map."""
        cell = ref(self.column)
        new = F.lit(False) if self.values is None else cell.isNotNull() & ~cell.isin(*self.values) if self.values else cell.isNotNull()
        return df.where(new).groupBy(cell.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def fit_one_hot(df: DataFrame, column: str, max_columns: int = MAX_COLUMNS) -> OneHotModel:
    found = (
        df.where(ref(column).isNotNull())
        .select(ref(column).alias("value"))
        .distinct()
        .limit(max_columns + 1)
        .collect()
    )
    return OneHotModel(column, None if len(found) > max_columns else sorted(r["value"] for r in found))


def one_hot_encode(
    df: DataFrame, column: str, max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """Replace the column by one boolean ``<column>_<value>`` per sorted value; NULL is
    false everywhere. Names that differ in case only, or that the table has, get a number
    behind them. Beyond ``max_columns`` values the result is one column
    ``<column>_one_hot``, a map from the cell's value to true (empty for NULL), of any
    number of values."""
    return fit_one_hot(df, column, max_columns).transform(df)


def encode_categorical(
    df: DataFrame, column: str, method: str = "Label", **options
) -> DataFrame:
    if column not in df.columns:
        return df
    if method == "One-Hot":
        return one_hot_encode(df, column, **options)
    return label_encode(df, column, **options)
