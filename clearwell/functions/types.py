"""Column classes by type and by name."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Name fragments that mark an identifier column and a date column.
ID_NAME_PARTS = (
    "id", "key", "code", "index", "tract", "zip", "postal",
    "phone", "fax", "ssn", "uuid", "guid",
)
DATE_NAME_PARTS = ("date", "time")

DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Carried through untouched: no ordering or no grouping is defined on them.
OPAQUE_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or backticks."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def truth_columns(df: DataFrame) -> list[str]:
    """Boolean columns: no numbers to the cleaning steps, but numeric to the profile."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def other_columns(df: DataFrame) -> list[str]:
    """Non-numeric columns that can be grouped: text, boolean, dates."""
    return [
        f.name
        for f in df.schema
        if not isinstance(f.dataType, (T.NumericType, *OPAQUE_TYPES))
    ]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def date_like_columns(df: DataFrame) -> list[str]:
    """Date typed, or named like a date whatever the type."""
    return [
        f.name
        for f in df.schema
        if is_datetime(f.dataType)
        or any(part in f.name.lower() for part in DATE_NAME_PARTS)
    ]


def is_id_like(name: str) -> bool:
    return any(part in name.lower() for part in ID_NAME_PARTS)
