"""Cells that stand for a missing value: marker texts and negative numbers."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.types import numeric_columns, ref

# Cell texts treated as invalid.
INVALID_TOKENS = ("na", "n/a", "none", "-", "--", "null", "nan")


def replace_invalid_values(
    df: DataFrame,
    columns: list[str] | None = None,
    invalid_tokens=INVALID_TOKENS,
    replace_with=None,
    treat_negative_as_invalid: bool = False,
) -> DataFrame:
    """Replace marker texts (any case, not trimmed) in the named text columns, and on
    request negative numbers in every numeric column."""
    tokens = sorted({str(t).lower() for t in invalid_tokens or INVALID_TOKENS})
    new = {}
    for name in columns or df.columns:
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
            cell = ref(name)
            new[name] = F.when(
                F.lower(cell).isin(*tokens), F.lit(replace_with).cast("string")
            ).otherwise(cell)
    if treat_negative_as_invalid:
        for name in numeric_columns(df):
            cell, dtype = ref(name), df.schema[name].dataType
            new[name] = F.when(cell < 0, F.lit(replace_with).try_cast(dtype)).otherwise(cell)
    return df.withColumns(new) if new else df
