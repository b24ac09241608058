"""Shared parts of the operators: batches of text as byte arrays, tables of links."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.packaging import ship
from ..functions.storage import drop_table, materialize

# A frame is broadcast only when counted and measured below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# Text bytes that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 20

UINT = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15  # any odd number with well-mixed bits
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


_HELD_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def hold_at_most(spark: SparkSession, rows: int) -> None:
    """From now on a task of the session reads, and hands to Python, at most so many rows at a time;
    a lower setting stays. Whole texts in the usual thousands are arrays of tens of megabytes, each
    several times over: in the heap, beside it and in Python."""
    for name in _HELD_ROWS:
        before = int(spark.conf.get(name))
        spark.conf.set(name, min(before, rows) if before > 0 else rows)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """``hold_at_most`` for the jobs run inside the block."""
    before = {name: spark.conf.get(name) for name in _HELD_ROWS}
    hold_at_most(spark, rows)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_or_plain(df: DataFrame, size: Column) -> DataFrame:
    """``df``, marked for broadcast if its counted rows and the sum of ``size`` (bytes
    per row) are below the bounds; else Spark picks a join that shuffles. ``df`` should
    be a written table, as it is read twice."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with a number behind it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    numbers = itertools.count(2)
    new = name
    while new.lower() in taken:
        new = f"{name}_{next(numbers)}"
    return new


# -- texts of an Arrow batch ------------------------------------------------- #


def text_slices(batch: pa.RecordBatch, index: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with some ``SLICE_BYTES`` of text: (rows, bytes, offsets of each
    text in them). A null text counts as empty."""
    column = batch.column(index).cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(n, max(at + 1, end))
        low, high = int(offsets[at]), int(offsets[end])
        yield batch.slice(at, end - at), data[low:high], offsets[at : end + 1] - low
        at = end


def row_slices(batches: Iterator[pa.RecordBatch], index: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of some ``SLICE_BYTES`` of text, so that Python holds
    little of it at a time."""
    for batch in batches:
        for rows, _, _ in text_slices(batch, index):
            yield rows


def word_table() -> np.ndarray:
    """Byte -> lower-cased byte of a word, or 0 for a separator: words are runs of
    ASCII letters, digits and everything beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


WORDS = word_table()
_SPLIT = bytes(x or 0x20 for x in WORDS.tolist())


def split_words(text: str | None) -> list[bytes]:
    """The lower-cased words of one text."""
    return (text or "").encode().translate(_SPLIT).split()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first word of each text and the total) of the
    words of the texts that lie one behind the other in ``data``."""
    low = WORDS[data]
    inside = low != 0
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(low))]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


_powers = [np.ones(1, UINT), np.ones(1, UINT)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((MULTIPLIER, INVERSE)):
            steps = np.full(n, base, UINT)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> UINT(32))) * UINT(0xD6E8FEB86659FD93)
    x = (x ^ (x >> UINT(32))) * UINT(0xD6E8FEB86659FD93)
    return x ^ (x >> UINT(32))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands: the difference of
    two prefix sums of a polynomial, shifted back to position 0."""
    power, inverse = _power_tables(len(low) + 1)
    sums = np.zeros(len(low) + 1, UINT)
    np.cumsum(low * power[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + UINT(1))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last ``k`` - 1 wrap around."""
    total = np.zeros(len(words), UINT)
    for j in range(k):
        total = total * UINT(MULTIPLIER) + np.roll(words, -j)
    return mix(total + UINT(k))


# -- components -------------------------------------------------------------- #


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that
    can be reached. Large-star and small-star steps: each hangs the neighbours of a node
    on the smallest of them, so paths halve and the rounds grow with the logarithm of
    the longest. Minima are partial aggregates, so a node with very many links is not
    gathered anywhere, and every round is written to the shared folder."""
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple[int, int, int]:
        mark = F.xxhash64("a", "b")
        return tuple(df.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(mark.bitwiseAND(0x7FFFFFFF)), F.lit(0)),
            F.coalesce(F.bit_xor(mark), F.lit(0)),
        ).first())

    now, path = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        label, with_path=True,
    )
    mark = state(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # Larger neighbours of n go to the smallest node around n.
        large = both.join(smallest, F.col("a") == F.col("n")).where("b > n").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        # Smaller neighbours of n, and n, go to the smallest of them.
        small = large.join(low, F.col("a") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a != b").distinct()
        then, new_path = materialize(small, label, with_path=True)
        after = state(then)
        drop_table(spark, path)
        now, path = then, new_path
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
