"""Text columns: trimming, case, and mapping spellings to one category."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.exprs import WHITESPACE, strip
from ..functions.types import ref, text_columns


def standardize_text_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    lowercase: bool = True,
    strip_space: bool = True,
) -> DataFrame:
    """Trim all Unicode whitespace and lower-case. NULL stays NULL, unknown names are
    ignored, and a named non-text column becomes text."""
    new = {}
    for name in columns or text_columns(df):
        if name not in df.columns or not (lowercase or strip_space):
            continue
        cell = ref(name).cast("string")
        if strip_space:
            cell = strip(cell)
        if lowercase:
            cell = F.lower(cell)
        new[name] = cell
    return df.withColumns(new) if new else df


def category_key(cell: Column) -> Column:
    return F.lower(strip(cell))


def standardize_categories(
    df: DataFrame, column: str, mapping: dict | DataFrame, source: str = "source", target: str = "target"
) -> DataFrame:
    """Swap values found in ``mapping`` (trimmed, any case) and keep the rest. Of a dict the
    first entry for a value wins. A table of any size, with columns ``source`` and
    ``target``, is joined; it has no order, so of several targets the smallest wins."""
    if column not in df.columns or (isinstance(mapping, dict) and not mapping):
        return df
    cell = ref(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        cell = cell.cast("string")
    if isinstance(mapping, DataFrame):
        return _mapped_by_table(df, column, cell, mapping, source, target)
    pairs = {}
    for name, new in mapping.items():
        pairs.setdefault(str(name).strip(WHITESPACE).lower(), new)
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, category_key(cell)), cell))


def _mapped_by_table(df, column, cell, mapping, source, target):
    """A left join that Spark broadcasts when the mapping is small by its own measure, and
    else shuffles, frequent categories split at run time. NULL cells stay out of it."""
    pairs = (
        mapping.select(category_key(ref(source).cast("string")).alias("__source"), ref(target).cast("string").alias("__target"))
        .where(F.col("__source").isNotNull())
        .groupBy("__source")
        .agg(F.min("__target").alias("__target"))
    )
    given = df.where(ref(column).isNotNull()).withColumn("__key", category_key(cell))
    joined = given.join(pairs, F.col("__key") == F.col("__source"), "left").withColumn(
        column, F.coalesce("__target", cell))
    empty = df.where(ref(column).isNull()).withColumn(column, F.lit(None).cast("string"))
    return joined.select(*[ref(c) for c in df.columns]).unionByName(empty)
