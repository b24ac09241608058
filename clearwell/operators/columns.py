"""Column operations: rename, change type, drop, clean names, filter, preview."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates
from ..functions.exprs import WHITESPACE, to_double, to_whole
from ..functions.types import ref


def rename_column(df: DataFrame, column: str, new_name: str | None) -> DataFrame:
    """No-op when the new name is empty or taken, or the column is absent."""
    if column not in df.columns or not new_name or new_name in df.columns:
        return df
    return df.withColumnRenamed(column, new_name)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column) if column in df.columns else df


def change_type(
    df: DataFrame,
    column: str,
    target_type: str,
    formats=None,
    missing_text: str | None = None,
) -> DataFrame:
    """Cast to ``int``, ``float``, ``string`` or ``datetime``; what does not parse
    becomes NULL. ``missing_text="nan"`` writes NULL as text when casting to
    string, the older behaviour."""
    if column not in df.columns:
        return df
    dtype, col = df.schema[column].dataType, ref(column)
    if target_type == "int":
        new = to_whole(col, dtype)
    elif target_type == "float":
        new = to_double(col, dtype)
    elif target_type == "string":
        new = col.cast("string")
        if missing_text is not None:
            new = F.coalesce(new, F.lit(missing_text))
    elif target_type == "datetime":
        df = dealt_dates(df, column, formats)
        new = column_as_datetime(df, column, formats)
    else:
        return df
    return df.withColumn(column, new)


def to_datetime(col: Column, dtype: T.DataType, formats=None, layout: dates.Layout = dates.Layout()) -> Column:
    """A time without zone, whatever the session's, or NULL for what is no date. Text is
    read in the ``layout`` of its column (see ``dates``), or in the ``formats`` given."""
    if isinstance(dtype, T.StringType):
        if formats:
            return F.coalesce(
                col.try_cast("timestamp_ntz"),
                *[F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in formats],
            )
        return dates.parsed(col, layout)
    if isinstance(dtype, T.NumericType):
        # Numbers count nanoseconds since 1970.
        return F.timestamp_micros((col / 1000).cast("bigint")).cast("timestamp_ntz")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def dealt_dates(df: DataFrame, column: str, formats=None) -> DataFrame:
    """``df``, in splits of a bounded number of rows if ``column_as_datetime`` has texts to read."""
    return dates.dealt(df) if isinstance(df.schema[column].dataType, T.StringType) and not formats else df


def column_as_datetime(df: DataFrame, column: str, formats=None) -> Column:
    """``to_datetime`` of a column, whose layout is counted first if it is text."""
    dtype = df.schema[column].dataType
    vote = isinstance(dtype, T.StringType) and not formats
    return to_datetime(ref(column), dtype, formats, dates.layout(df, column) if vote else dates.Layout())


def clean_name(name: str) -> str:
    name = name.strip(WHITESPACE)
    for mark in " -/":
        name = name.replace(mark, "_")
    return name.lower()


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim, put ``_`` for blanks, dashes and slashes, lower-case. Two columns that
    end up with one name are an error, as Spark could not tell them apart."""
    new = [clean_name(c) for c in df.columns]
    clashes = sorted({n for n in new if new.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {', '.join(clashes)}")
    return df.toDF(*new)


def keep_unflagged(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag (a non-null boolean) is false."""
    return df.where(~flag)


def preview(
    df: DataFrame, order_by: list[str], rows: int = 10, max_columns: int | None = None
) -> DataFrame:
    """First rows under an explicit order; a per-partition top-k, not a full sort."""
    shown = df.columns[:max_columns] if max_columns else df.columns
    return df.orderBy(*[ref(c) for c in order_by]).limit(rows).select(*[ref(c) for c in shown])


def apply_column_operation(
    df: DataFrame, operation: str, column: str, **options
) -> DataFrame:
    """Dispatch by operation name; an absent column leaves the table unchanged."""
    from .encode import encode_categorical, factorize

    if column not in df.columns:
        return df
    if operation == "Rename column":
        return rename_column(df, column, options.get("new_name"))
    if operation == "Change datatype":
        return change_type(df, column, **options)
    if operation == "Drop column":
        return drop_column(df, column)
    if operation == "Encode categorical":
        if isinstance(df.schema[column].dataType, T.StringType):
            return encode_categorical(df, column, "Label", **options)
        return factorize(df, column, **options)
    return df
