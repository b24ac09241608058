"""Allowed numeric range of one column."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.exprs import to_double
from ..functions.types import ref


def validate_range(
    df: DataFrame,
    column: str,
    min_value: float | None = None,
    max_value: float | None = None,
    mode: str = "cap",
) -> DataFrame:
    """``cap`` clips to the range, ``nan`` turns what lies outside into NULL. Text is
    read as numbers first; NULL stays NULL; an absent column is a no-op."""
    if column not in df.columns:
        return df
    dtype, cell = df.schema[column].dataType, ref(column)
    if not isinstance(dtype, T.NumericType):
        cell = to_double(cell, dtype)
    value = cell
    if min_value is not None:
        value = F.when(cell < min_value, F.lit(min_value if mode == "cap" else None)).otherwise(value)
    if max_value is not None:
        value = F.when(cell > max_value, F.lit(max_value if mode == "cap" else None)).otherwise(value)
    return df.withColumn(column, value)
