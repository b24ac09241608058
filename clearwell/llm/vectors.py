"""Integer vectors: what the operators on embeddings have in common."""

from pyspark.sql import Column, DataFrame, functions as F

from .topk import usable

SCALE = 1024
# Components are held within this distance of 0, so that differences of two fit a long.
LIMIT = 1 << 61


def scaled(vector: Column, shift: int = 0) -> Column:
    """floor(SCALE * x) + ``shift`` of every component, as long, the floor held within ``LIMIT``."""

    def whole(x: Column) -> Column:
        return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * F.lit(float(SCALE))))) + F.lit(shift)

    return F.transform(vector.cast("array<double>"), whole)


def whole_rows(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is not null and holds no null or non-finite component."""
    return df.where(usable(F.col(vector_col).cast("array<double>")))


def filled(vector: Column, width: int, value: int = 0) -> Column:
    """A vector of ``width`` components, those that are missing being ``value``."""
    missing = F.array_repeat(F.lit(value).cast("bigint"), F.lit(width) - F.size(vector))
    return F.when(F.size(vector) < width, F.concat(vector, missing)).otherwise(vector)
