"""Ranking distinct values and joining a table to a per-value lookup, at any size."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import materialize
from .types import ref

# A lookup is broadcast only when counted and measured below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Distinct values up to which one task may number them all.
SINGLE_TASK_ROWS = 500_000
# A value with more than rows / HOT_SHARE copies is hot: there are at most
# HOT_SHARE of them in any table.
HOT_SHARE = 500
SALTS = 64


def number_rows(
    values: DataFrame, order: list[str], rows: int, name: str, single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Add the 0-based position of each row under ``order``, which must be unique.
    Small tables use one window; larger ones are range-partitioned, numbered within
    each partition and shifted by the sizes of the partitions before."""
    by = [ref(c) for c in order]
    if rows <= single_task_rows:
        return values.withColumn(name, F.row_number().over(Window.orderBy(*by)) - 1)
    parts = max(2, -(-rows // single_task_rows))
    # Written once, so that both reads below see the same partition borders.
    sorted_parts = materialize(
        values.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()),
        "value-ranks",
    )
    sizes = sorted_parts.groupBy("__part").count()
    # One row per part: their running sum is taken in one task, and joined as a table.
    before = F.sum("count").over(Window.orderBy("__part")) - F.col("count")
    starts = sizes.select(F.col("__part").alias("__of"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    return (
        sorted_parts.withColumn("__within", within)
        .join(F.broadcast(starts), F.col("__part") == F.col("__of"))
        .withColumn(name, (F.col("__within") + F.col("__before")).cast("int" if rows < 2**31 else "bigint"))
        .drop("__part", "__of", "__before", "__within")
    )


def join_lookup(
    df: DataFrame,
    key: Column,
    lookup: DataFrame,
    lookup_key: str,
    copies: str,
    rows: int,
    total: int,
    bytes_: int,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join ``df`` to one lookup row per key value. ``copies`` names the lookup
    column with the number of table rows per value and is dropped. A small lookup is
    broadcast. Otherwise both sides are shuffled, and the few hot values are spread
    over salted copies of their lookup row."""
    if rows <= broadcast_rows and bytes_ <= BROADCAST_BYTES:
        side = lookup.drop(copies).withColumnRenamed(lookup_key, "__key")
        return (
            df.withColumn("__probe", key)
            .join(F.broadcast(side), F.col("__probe") == F.col("__key"), "left")
            .drop("__probe", "__key")
        )
    hot = F.col(copies) * HOT_SHARE > total
    hot_values = lookup.where(hot).select(F.col(lookup_key).alias("__hot"))
    side = (
        lookup.withColumn(
            "__salt",
            F.explode(
                F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop(copies)
        .withColumnRenamed(lookup_key, "__key")
    )
    probe = (
        df.withColumn("__probe", key)
        .join(F.broadcast(hot_values), F.col("__probe") == F.col("__hot"), "left")
        .withColumn(
            "__spread",
            # The partition number is the same when a task is run again.
            F.when(F.col("__hot").isNotNull(), F.spark_partition_id() % SALTS).otherwise(0),
        )
        .drop("__hot")
    )
    return probe.join(
        side,
        (F.col("__probe") == F.col("__key")) & (F.col("__spread") == F.col("__salt")),
        "left",
    ).drop("__probe", "__spread", "__key", "__salt")
