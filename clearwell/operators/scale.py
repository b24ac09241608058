"""Min-max and standard scaling into new columns."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import stats
from ..functions.types import numeric_columns, ref

SUFFIXES = {"Min-Max": "_scaled", "Standard": "_std"}


@dataclass
class ScaleModel:
    """New column = (column - shift) / width."""

    shifts: dict[str, tuple[float, float]]
    suffix: str

    @property
    def added(self) -> list[str]:
        return [c + self.suffix for c in self.shifts]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {
            c + self.suffix: (ref(c).cast("double") - shift) / width
            for c, (shift, width) in self.shifts.items()
        }
        return df.withColumns(new) if new else df


def fit_scale(df: DataFrame, method: str = "Min-Max") -> ScaleModel:
    """Skips scaled columns and constant ones; a spread at the level of rounding noise
    counts as constant."""
    columns = [
        c for c in numeric_columns(df) if not c.endswith(tuple(SUFFIXES.values()))
    ]
    found = {}
    if columns:
        found = (stats.moments if method == "Standard" else stats.spans)(df, columns).columns
    shifts = {}
    for name, m in found.items():
        if not m.n:
            continue
        if method == "Standard":
            if m.deviation > 1e-12 * abs(m.mean):
                shifts[name] = (m.mean, m.deviation)
        elif m.high != m.low:
            shifts[name] = (m.low, m.high - m.low)
    return ScaleModel(shifts, SUFFIXES["Standard" if method == "Standard" else "Min-Max"])


def scale_numeric(df: DataFrame, method: str = "Min-Max") -> DataFrame:
    return fit_scale(df, method).transform(df)
