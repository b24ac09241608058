"""Missing values: drop, or fill with mean, median, mode or nearest neighbours."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import stats
from ..functions.types import numeric_columns, other_columns, ref

STRATEGIES = ("Drop", "Mean", "Median", "Mode", "KNN Imputation")


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Commonest value per column, smallest on a tie; None for an all-NULL column."""
    if not columns:
        return {}
    counts = stats.value_counts(df, columns).where(stats.has_value())
    best = (
        counts.groupBy("ordinal")
        .agg(F.min(F.struct(-F.col("n"), *stats.SLOTS)).alias("best"))
        .select("ordinal", *[f"best.{slot}" for slot in stats.SLOTS])
        .collect()  # one row per column
    )
    values = {
        columns[r["ordinal"]]: next(r[slot] for slot in stats.SLOTS if r[slot] is not None) for r in best
    }
    return {c: values.get(c) for c in columns}


@dataclass
class FillModel:
    """One literal per column; applies to batch and streaming tables alike."""

    fills: dict[str, object]
    as_double: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for name in df.columns:
            dtype = df.schema[name].dataType
            value = self.fills.get(name)
            if name in self.as_double:
                col = stats.as_number(df, name)
                new[name] = col if value is None else F.coalesce(col, F.lit(float(value)))
            elif value is not None:
                held = F.when(stats.present(df, name), ref(name))
                new[name] = F.coalesce(held, F.lit(value).cast(dtype))
        return df.withColumns(new) if new else df


def fit_fill(
    df: DataFrame,
    strategy: str,
    accuracy: int | None = None,
    all_columns: bool = False,
    nulls: dict[str, int] | None = None,
) -> FillModel:
    """Learn fill values. Columns without a NULL are skipped unless ``all_columns``
    (for a model that will meet other data, such as a stream). An all-NULL column
    has no fill value and stays NULL. ``nulls``, the NULL cells per column, saves a
    scan when known."""
    numeric, other = numeric_columns(df), other_columns(df)
    if all_columns:
        with_gaps = set(numeric + other)
    else:
        if nulls is None:
            _, nulls = stats.null_counts(df, numeric + other)
        with_gaps = {c for c, n in nulls.items() if n}
    gaps = [c for c in numeric if c in with_gaps]
    modes = [c for c in other if c in with_gaps]
    fills: dict[str, object] = {}
    if strategy == "Mean":
        found = stats.moments(df, gaps).columns if gaps else {}
        fills.update({c: m.mean for c, m in found.items()})
    elif strategy == "Median":
        found = stats.quantiles(df, gaps, [0.5], accuracy=accuracy)
        fills.update({c: q[0] for c, q in found.items()})
    elif strategy == "Mode":
        modes = gaps + modes
    else:
        raise ValueError(f"no fill values for strategy {strategy!r}")
    fills.update(most_frequent(df, modes))
    return FillModel(fills, numeric if strategy in ("Mean", "Median") else [])


def handle_missing_values(df: DataFrame, strategy: str, **options) -> DataFrame:
    """Apply one of ``STRATEGIES``. Any other name leaves the table unchanged."""
    if strategy == "Drop":
        return df.na.drop("any")
    if strategy in ("Mean", "Median", "Mode"):
        return fit_fill(df, strategy, **options).transform(df)
    if strategy == "KNN Imputation":
        from .knn import knn_impute

        filled = knn_impute(df, **options)
        _, nulls = stats.null_counts(df, other_columns(df))
        modes = most_frequent(df, [c for c, n in nulls.items() if n])
        return FillModel(modes, []).transform(filled)
    return df
