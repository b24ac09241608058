"""Row-wise outlier flags from per-column fences."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import stats
from ..functions.exprs import any_of
from ..functions.types import numeric_columns, ref


@dataclass
class IqrModel:
    """Fences per column. An all-NULL column has fences (None, None)."""

    fences: dict[str, tuple[float | None, float | None]]
    null_is_outlier: bool = True

    def column_flag(self, name: str) -> Column:
        low, high = self.fences[name]
        if low is None:
            return F.lit(self.null_is_outlier)
        # NaN is above every number, so it lies outside like NULL; unless NULL is none.
        number = F.nanvl(ref(name).cast("double"), F.lit(None).cast("double"))
        inside = number.between(low, high)
        return ~F.coalesce(inside, F.lit(not self.null_is_outlier))

    def flag(self) -> Column:
        return any_of(self.column_flag(c) for c in self.fences)

    def transform(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        return df.withColumn(name, self.flag())

    def remove(self, df: DataFrame) -> DataFrame:
        return df.where(~self.flag())


def fit_iqr(
    df: DataFrame,
    columns: list[str] | None = None,
    null_is_outlier: bool = True,
    accuracy: int | None = None,
    summary: stats.TableMoments | None = None,
) -> IqrModel:
    """Quartile fences at 1.5 interquartile ranges; columns with no spread are left
    out. A NULL cell lies outside every fence unless ``null_is_outlier=False``."""
    columns = numeric_columns(df) if columns is None else columns
    fences = {}
    for name, (q1, q3) in stats.quantiles(
        df, columns, [0.25, 0.75], accuracy=accuracy, summary=summary
    ).items():
        if q1 is None:
            fences[name] = (None, None)
        elif q3 != q1:
            reach = 1.5 * (q3 - q1)
            fences[name] = (q1 - reach, q3 + reach)
    return IqrModel(fences, null_is_outlier)


@dataclass
class ZScoreModel:
    centres: dict[str, tuple[float, float]]
    threshold: float = 3.0

    def flag(self) -> Column:
        return any_of(
            F.coalesce(
                F.abs((F.nanvl(ref(c).cast("double"), F.lit(None).cast("double")) - mean) / deviation) > self.threshold,
                F.lit(False),
            )
            for c, (mean, deviation) in self.centres.items()
        )

    def transform(self, df: DataFrame, name: str = "is_outlier") -> DataFrame:
        return df.withColumn(name, self.flag())

    def remove(self, df: DataFrame) -> DataFrame:
        return df.where(~self.flag())


def fit_zscore(df: DataFrame, threshold: float = 3.0) -> ZScoreModel:
    """Population z-scores; constant columns are skipped, NULL is never flagged."""
    columns = numeric_columns(df)
    found = stats.moments(df, columns).columns if columns else {}
    return ZScoreModel(
        {c: (m.mean, m.deviation) for c, m in found.items() if m.n and m.deviation > 0},
        threshold,
    )


def detect_outliers_iqr(df: DataFrame, **options) -> DataFrame:
    return fit_iqr(df, **options).transform(df)


def detect_outliers_zscore(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    return fit_zscore(df, threshold).transform(df)


def remove_outliers(df: DataFrame, method: str = "IQR", **options) -> DataFrame:
    """Rows left after ``IQR``, ``Z-Score`` or ``Isolation Forest`` detection."""
    if method == "IQR":
        return fit_iqr(df, **options).remove(df)
    if method == "Z-Score":
        return fit_zscore(df, **options).remove(df)
    if method == "Isolation Forest":
        from .isolation import flag_anomalies

        flagged = flag_anomalies(df, **options)
        return flagged.where(~F.col("is_outlier")).drop("is_outlier")
    raise ValueError(f"unknown outlier method {method!r}")
