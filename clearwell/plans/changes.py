"""What a step did to a table, as the rows and cells that it changed.

Two versions of a table with a key are compared once. Stored are the keys of rows that went, whole rows that
came, and for the other rows that differ the cells that differ; columns that are new or of another type are
stored whole, columns that went are only named. A version is the one before with these changes merged in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.exprs import any_of
from ..functions.storage import materialize
from ..functions.types import ref


@dataclass
class ChangeSet:
    """``cells``: the columns ``k0``, ``k1``, .. of the key, ``kind`` (gone, came or changed) and, for
    each column that may have changed, a struct of its new value, null where the cell is as before.
    ``places`` names these columns, ``schema`` is that of the later version."""

    key: list[str]
    schema: T.StructType
    places: dict[str, str]
    cells: DataFrame

    def apply(self, before: DataFrame) -> DataFrame:
        """The later version, from the earlier one."""
        earlier = before.select(
            *[ref(k).alias(f"k{i}") for i, k in enumerate(self.key)],
            *[ref(f.name).alias(f"b{i}") for i, f in enumerate(self.schema) if self._kept(f.name, before)])
        same = _same_key("k", "c", len(self.key))
        cells = self.cells.withColumnsRenamed({f"k{i}": f"c{i}" for i in range(len(self.key))})
        out = []
        for i, f in enumerate(self.schema):
            place = self.places.get(f.name)
            old = F.col(f"b{i}") if self._kept(f.name, before) else F.lit(None).cast(f.dataType)
            if f.name in self.key:
                out.append(F.col(f"k{self.key.index(f.name)}").alias(f.name))
            elif place is None:
                out.append(old.alias(f.name))
            else:
                out.append(F.when(F.col(place).isNotNull(), F.col(f"{place}.v")).otherwise(old).alias(f.name))
        kept = earlier.join(cells.where("kind != 'came'"), same, "left").where("kind is null or kind != 'gone'").select(*out)
        came = self.cells.where("kind = 'came'").select(*[
            (F.col(f"k{self.key.index(f.name)}") if f.name in self.key else F.col(f"{self.places[f.name]}.v") if f.name in self.places
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema])
        return kept.unionByName(came)

    def _kept(self, name: str, before: DataFrame) -> bool:
        return name in before.columns and before.schema[name].dataType == self.schema[name].dataType


def _same_key(left: str, right: str, width: int) -> Column:
    same = F.lit(True)
    for i in range(width):
        same = same & F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}"))
    return same


def _check_key(df: DataFrame, key: list[str]) -> None:
    if not df.groupBy(*[ref(k) for k in key]).count().where("count > 1").isEmpty():
        raise ValueError(f"rows are not told apart by {', '.join(key)}")


def difference(before: DataFrame, after: DataFrame, key: list[str], check: bool = True) -> ChangeSet:
    """The changes from ``before`` to ``after``, which both hold the columns of ``key`` in one type;
    rows of equal keys are an error (not looked for without ``check``)."""
    for k in key:
        if k not in after.columns or after.schema[k].dataType != before.schema[k].dataType:
            raise ValueError(f"the key column {k} is gone or of another type")
    if check:
        _check_key(before, key)
        _check_key(after, key)
    named = {f.name for f in before.schema}
    others = [f for f in after.schema if f.name not in key]
    old = [f for f in others if f.name in named and before.schema[f.name].dataType == f.dataType]
    new = [f for f in others if f not in old]
    place = {f.name: f"n{i}" for i, f in enumerate(others)}
    left = before.select(F.lit(True).alias("was"), *[ref(k).alias(f"k{i}") for i, k in enumerate(key)], *[ref(f.name).alias(f"b_{place[f.name]}") for f in old])
    right = after.select(F.lit(True).alias("is"), *[ref(k).alias(f"c{i}") for i, k in enumerate(key)], *[ref(f.name).alias(place[f.name]) for f in others])
    met = left.join(right, _same_key("k", "c", len(key)), "full")
    kind = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "came").otherwise("changed")

    def differs(f: T.StructField) -> Column:
        a, b = F.col(f"b_{place[f.name]}"), F.col(place[f.name])
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            return ~F.to_json(F.struct(a.alias("v"))).eqNullSafe(F.to_json(F.struct(b.alias("v"))))
        return ~a.eqNullSafe(b)

    came = F.col("was").isNull() & F.col("is").isNotNull()
    cells = {f.name: F.when(came | (differs(f) if f in old else F.col("is").isNotNull()), F.struct(F.col(place[f.name]).alias("v"))) for f in others}
    cells = {n: F.when(F.col("is").isNotNull(), c).alias(place[n]) for n, c in cells.items()}
    rows = met.where(any_of([F.col("is").isNull(), F.col("was").isNull(), F.lit(bool(new)), *[differs(f) for f in old]]))
    keys = [F.when(F.col("is").isNull(), F.col(f"k{i}")).otherwise(F.col(f"c{i}")).alias(f"k{i}") for i in range(len(key))]
    written = materialize(rows.select(*keys, kind.alias("kind"), *cells.values()), "changes")
    return ChangeSet(list(key), after.schema, place, written)
