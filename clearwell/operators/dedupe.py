"""Duplicate rows."""

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.types import ref


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype)
    return False


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each identical row. Copies combine on the map side, so a row that
    fills a third of the table costs one row per task in the shuffle. Map and
    variant cells have no equality of their own and are compared as JSON."""
    awkward = [f.name for f in df.schema if _has_map(f.dataType)]
    if not awkward:
        return df.dropDuplicates()
    keys = [F.to_json(ref(c)) if c in awkward else ref(c) for c in df.columns]
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    grouped = df.groupBy(*named).agg(
        *[F.any_value(ref(c)).alias(c) for c in awkward]
    )
    return grouped.select(
        *[
            ref(c) if c in awkward else F.col(f"k{i}").alias(c)
            for i, c in enumerate(df.columns)
        ]
    )
