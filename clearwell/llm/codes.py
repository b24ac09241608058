"""Short codes of vectors: product quantisation by member-resident Lloyd rounds.

A vector is cut into ``POSITIONS`` equal parts and each part is replaced by the number of the
nearest entry of its position's codebook. The parts live in bucketed tables with one owner for
each (position, entry, salt). A round has three steps:

* owners add up their resident members, without a shuffle, and the sums of an entry's owners
  make its new value; entries (``ENTRIES`` vectors) go to all tasks,
* every owner looks for the nearest entry of its members and writes them where they are, those
  that stay apart from those that leave,
* only those that leave are shuffled, to the owners of their new entries.

The salt (a hash of the row) spreads an entry, which copies may make as large as a third of the
table, over many owners; their number grows with the table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.storage import drop_table, fresh_path, materialize
from .common import arrow_map, small_or_plain
from .vectors import filled, scaled, whole_rows

POSITIONS = 4
ENTRIES = 256
ROUNDS = 4
# Salts that an entry is spread over: some at any size, more in a table of very many rows.
LEAST_SALTS = 64
OWNER_ROWS = 1 << 18
# Parts that a bucket holds, about.
BUCKET_PARTS = 1 << 21
# Rows whose distances a task holds at a time.
CHUNK = 4096
OWNER = ("position", "entry", "salt")
_LONG = np.iinfo(np.int64).max


# -- in a task --------------------------------------------------------------- #


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``entries`` for each row of ``parts``;
    ties go to the lower index. Exact: in doubles where no sum leaves their exact range, else in
    whole numbers, held at the largest long."""
    largest = max(abs(int(x)) for a in (parts, entries) for x in (a.max(initial=0), a.min(initial=0)))
    if 4 * largest * largest * max(1, parts.shape[1]) < 2**53:
        a, b = parts.astype(np.float64), entries.astype(np.float64)
        own = (b * b).sum(axis=1)
        index = np.empty(len(a), np.int64)
        least = np.empty(len(a), np.int64)
        for at in range(0, len(a), CHUNK):
            some = a[at : at + CHUNK]
            away = own - 2.0 * (some @ b.T)
            index[at : at + CHUNK] = away.argmin(axis=1)
            least[at : at + CHUNK] = away.min(axis=1) + (some * some).sum(axis=1)
        return index, least
    found = []
    b = entries.astype(object)
    for part in parts.astype(object):
        away = ((b - part) ** 2).sum(axis=1)
        found.append((int(np.argmin(away)), min(_LONG, int(away.min()))))
    return np.array([i for i, _ in found], np.int64), np.array([d for _, d in found], np.int64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _assign(codebooks: np.ndarray):
    """Adds ``next`` and ``away``: the nearest entry and its squared distance. Batches hold
    parts of several positions; ``position`` and ``part`` are their first and last columns."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            position = batch.column(0).to_numpy(zero_copy_only=False)
            parts = _matrix(batch.column(batch.num_columns - 1))
            index, away = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
            for p in np.unique(position):
                mine = position == p
                index[mine], away[mine] = nearest(parts[mine], codebooks[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index), pa.array(away)], [*batch.schema.names, "next", "away"])

    return run


# -- resident members -------------------------------------------------------- #


class _Tables:
    """Bucketed tables by owner in the shared folder; dropped when they are replaced."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def write(self, df: DataFrame, *divide: str) -> str:
        name = f"members_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, "members")
        out = df.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, *OWNER)
        (out.partitionBy(*divide) if divide else out).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_table(self.spark, self.paths.pop(name))

    def sent(self, df: DataFrame) -> str:
        """Shuffles ``df`` to the owners of its entries and writes it there."""
        return self.write(df.repartition(self.buckets, *OWNER))


def _sums(members: DataFrame, kind: str) -> DataFrame:
    """Owners' sums: the grouping holds the bucketing, so nothing is shuffled."""
    return members.select(*OWNER, F.posexplode("part").alias("at", "x")).groupBy(*OWNER, "at").agg(
        F.sum(F.col("x").cast(kind)).alias("total"), F.count(F.lit(1)).cast(kind).alias("n"))


def _updated(codebooks: np.ndarray, residents: list[DataFrame], kind: str) -> np.ndarray:
    """The floors of the means of all members; entries without members stay. One line for each
    component of an entry comes to the driver."""
    owners = _sums(residents[0], kind)
    for more in residents[1:]:
        owners = owners.unionByName(_sums(more, kind))
    means = owners.groupBy("position", "entry", "at").agg(F.sum("total").alias("t"), F.sum("n").alias("m")).select(
        "position", "entry", "at", F.expr("(t - pmod(t, m)) div m").cast("bigint").alias("mean"))
    new = codebooks.copy()
    for r in means.collect():
        new[r.position, r.entry, r["at"]] = r["mean"]
    return new


def _first_codebooks(rows: DataFrame, positions: int, entries: int, width: int) -> np.ndarray:
    """The parts of the rows of the smallest ids (null ids last, ties by vector)."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    vectors = np.array([r.v for r in first], np.int64).reshape(len(first), positions * width)
    return np.ascontiguousarray(vectors.reshape(len(first), positions, width).transpose(1, 0, 2))


def train(rows: DataFrame, width: int, count: int, largest: int, positions: int = POSITIONS, entries: int = ENTRIES,
          rounds: int = ROUNDS, stats: list | None = None) -> tuple[np.ndarray, DataFrame]:
    """(codebooks, parts): the codebooks (position, entry, component) after ``rounds`` rounds over
    ``rows`` (row, id, v), and the table (position, row, next, away) of all parts by them.
    ``count`` rows have components of ``width`` a part, none larger than ``largest``. ``stats``
    gets the number of parts that each shuffle moves."""
    spark = rows.sparkSession
    codebooks = _first_codebooks(rows, positions, entries, width)
    kind = "bigint" if largest * count < 2**62 else "decimal(38,0)"
    salts = max(LEAST_SALTS, -(-count // OWNER_ROWS))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Tables(spark, max(shuffles, -(-count * positions // BUCKET_PARTS)))
    cut = rows.select("row", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(positions - 1)),
        lambda p: F.struct(p.alias("position"), F.slice("v", p * width + 1, width).alias("part")))).alias("p"))
    parts = cut.select(F.col("p.position").alias("position"), "row", F.lit(-1).alias("entry"),
                       F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.col("p.part").alias("part"))
    schema = "position int, row bigint, entry int, salt int, part array<bigint>, next int, away bigint"
    found = arrow_map(parts, _assign(codebooks), schema)
    kept = ("position", "row", F.col("next").alias("entry"), "salt", "part")
    live = [tables.sent(found.select(*kept))]
    members = [spark.table(live[0])]
    if stats is not None:
        stats.append(members[0].count())
    for number in range(rounds):
        codebooks = _updated(codebooks, members, kind)
        now = members[0]
        for more in members[1:]:
            now = now.unionByName(more)
        found = arrow_map(now.select("position", "row", "entry", "salt", "part"), _assign(codebooks), schema)
        if number == rounds - 1:
            done = materialize(found.select("position", "row", "next", "away"), "codes")
            tables.drop(*live)
            return codebooks, done
        # Where they are: those that stay and those that leave, in files of their owner.
        there = tables.write(found.withColumn("leaves", F.col("next") != F.col("entry")), "leaves")
        tables.drop(*live)
        stay = spark.table(there).where("not leaves").select("position", "row", "entry", "salt", "part")
        come = tables.sent(spark.table(there).where("leaves").select(*kept))
        live, members = [there, come], [stay, spark.table(come)]
        if stats is not None:
            stats.append(members[1].count())
    done = materialize(arrow_map(members[0], _assign(codebooks), schema).select("position", "row", "next", "away"), "codes")
    tables.drop(*live)
    return codebooks, done


def _held(total: Column) -> Column:
    """A sum of longs, held at the largest long."""
    return F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")


def _exact(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,0)"))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, stats: list | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), codebooks): for every row the numbers of its parts' entries, two
    hexadecimal digits (or more for more entries) each, and the sum of their squared distances.

    Rows whose vector is null or holds a null or non-finite component take no part. Components
    become floor(1024 * x). Vectors are cut into ``positions`` parts of equal length; shorter ones,
    and lengths that cannot be cut so, are filled up with 0. Repeated rows, and rows of a null or
    repeated id, are coded each; among the first entries null ids come last and ties go by vector.
    A table of fewer than ``entries`` rows has fewer entries, an empty one no row and an empty
    codebook. Errors beyond a long are held at its largest value. Other columns are not read."""
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    rows = materialize(whole_rows(vectors, vector_col).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), label.alias("label"),
        scaled(F.col(vector_col)).alias("v")), "vectors")
    count, longest, high, low = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.array_max("v")), F.lit(0)), F.coalesce(F.min(F.array_min("v")), F.lit(0))).first()
    width = max(1, -(-longest // positions))
    if not count:
        empty = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty, np.zeros((positions, 0, width), np.int64)
    even = rows.select("row", "id", filled(F.col("v"), positions * width).alias("v"))
    codebooks, parts = train(even, width, count, max(high, -low), positions, entries, rounds, stats)
    digits = max(2, len(f"{entries - 1:x}"))
    coded = parts.groupBy("row").agg(
        F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.struct("position", "next"))),
            lambda e: F.lpad(F.lower(F.hex(e["next"])), digits, "0"))).alias("code"),
        _held(_exact("away")).alias("error"))
    return rows.select("row", "id", "label").join(coded, "row").drop("row"), codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over the rows of equal label (nulls are equal).
    Labels are summed first, so a frequent one meets its rows as one line."""
    coded = materialize(coded, "coded")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(_held(_exact("error")).alias("label_error")), "label-errors")
    side = small_or_plain(sums, F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + F.lit(16))
    return coded.join(side, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_codes(spark, folder):
    coded, codebooks = compress(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
