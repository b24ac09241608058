"""Near copies by SimHash.

Each text becomes a 64-bit fingerprint. Links join fingerprints that differ in at most
``BITS`` = 3 bits; classes are what can be reached over links. ``keep_one`` has these links and,
as 3 bits hold exact and almost exact copies only, those of ``resemblance`` besides.

Links are found in an embedding: a fingerprint is cut into 32 segments of two bits, and
each segment becomes its bit count. The Manhattan distance of two such vectors is never
above the Hamming distance of the fingerprints. Of the two halves of a pair with three
differing bits, one half has at most one, so its vectors are at distance 0 or 1. Each half
is therefore a grid of cells (its vector of 16 counts), in which a range join meets the own
cell and those one count away: all pairs that can be links, about 6 in a million of all
pairs of random fingerprints. Every candidate is then verified bit by bit.

Only distinct fingerprints enter the join, so copies of a text, however many, are one
point; a ball of radius r holds a bounded number of points whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.storage import materialize, scratch
from . import resemblance
from .common import arrow_map, batches_of, components, row_slices, small_or_plain, unused

WORDS_PER_SHINGLE = 3
SEED = 42
BITS = 3
CHUNK = 1 << 16
# Texts that Python holds at a time where it also makes their minima.
TEXT_ROWS = 2_000
_PAIRS = 0x55555555


def fingerprint(text: str | None, k: int = WORDS_PER_SHINGLE) -> int:
    """Bit i is set if more than half of the shingle hashes have it; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(k, len(words))
    n = len(words) - k + 1
    spans = list(zip(starts[:n].tolist(), ends[k - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = np.array([digest(line[a:b], SEED) for a, b in spans[at : at + CHUNK]], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in row_slices(batches, 1):
        marks = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], ["id", "mark"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark): the fingerprint of every text, as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _fingerprints, "id bigint, mark bigint")


def _half(mark: Column, high: bool) -> Column:
    return F.shiftrightunsigned(mark, 32) if high else mark.bitwiseAND(F.lit(0xFFFFFFFF))


def _counts(half: Column) -> Column:
    """The bit counts of 16 segments of two bits, packed in one number."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(_PAIRS))


def links(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct ``mark`` values that differ in at most
    ``bits`` (3 at most) bits."""
    if bits > 3:
        raise ValueError("the grid proves links of up to 3 differing bits")
    halves = marks.select("mark", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn(
        "cell", F.when(F.col("half") == 1, _counts(_half(F.col("mark"), True))).otherwise(_counts(_half(F.col("mark"), False)))
    )
    # Two cells at distance 1 have one odd and one even sum: only even ones look around.
    around = F.expr("""filter(flatten(transform(sequence(0, 15), i -> array(
        if((shiftright(cell, 2 * i) & 3) < 2, cell + shiftleft(1L, 2 * i), null),
        if((shiftright(cell, 2 * i) & 3) > 0, cell - shiftleft(1L, 2 * i), null)))), x -> x is not null)""")
    even = F.bit_count(F.when(F.col("half") == 1, _half(F.col("mark"), True)).otherwise(_half(F.col("mark"), False))) % 2 == 0
    probe = halves.select(
        F.col("mark").alias("a"), F.col("half").alias("h"),
        F.explode(F.when(even, F.concat(F.array(F.col("cell")), around)).otherwise(F.array(F.col("cell")))).alias("c"),
        F.col("cell").alias("own"),
    )
    pairs = probe.join(
        halves.select(F.col("mark").alias("b"), "half", "cell"),
        (F.col("h") == F.col("half")) & (F.col("c") == F.col("cell")) & ((F.col("c") != F.col("own")) | (F.col("a") < F.col("b")))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits),
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, mark, class_id) for every row. class_id is the smallest id among all rows whose
    fingerprints can be reached over links.

    A null or empty text has fingerprint 0 and is linked like any other. Rows of a null id
    keep their row; they never give a class its id, and a class of such rows only has a
    null one. Repeated rows stay repeated. An empty table gives an empty result. Other
    columns are not read, whatever their names."""
    marks = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    points = materialize(marks.groupBy("mark").agg(F.min("id").alias("first")), "points")
    roots = components(materialize(links(points, bits), "links"), "links")
    # Points without links are their own class; only linked ones meet the roots.
    linked = points.join(roots, F.col("mark") == F.col("node"), "left")
    lowest = points.join(roots, F.col("mark") == F.col("node")).groupBy(F.col("root").alias("top")).agg(F.min("first").alias("lowest"))
    classes = linked.join(lowest, F.col("root") == F.col("top"), "left").select(
        F.col("mark").alias("point"), F.coalesce("lowest", "first").alias("class_id"))
    # A frequent fingerprint makes a large partition of `marks` only, which AQE splits.
    return marks.join(classes, F.col("mark") == F.col("point")).select("id", "mark", "class_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = resemblance.SIMILARITY, exact: bool = False,
) -> DataFrame:
    """One row of ``docs`` for each class of near copies, all columns as they are: the row of
    the smallest id (null only if there is no other), of equal ids the one of the smallest mark and
    text hash, of repeated rows any. Texts are linked whose fingerprints differ in at most ``BITS`` bits
    (``links``, as in ``near_copies``), and those whose sets of five-word shingles have a Jaccard index of
    ``similarity`` or more (``exact`` as in ``resemblance``); null texts and those without words are
    one class. An empty table gives an empty one. Column names are free.

    Texts are not written: a row is known by its id and the hash of its text, and copies of a
    text are one point from the start."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        gone, repeated, paths = _decided(rows.select("id", F.xxhash64("text").alias("digest"), "text"), similarity, exact)
        for path in paths:
            keep(path)
    return _without(docs, gone, repeated, F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col).cast("string")))


def _marks(batches):
    """(id, digest, text) -> (id, digest, mark, print, minima): ``resemblance``'s and the fingerprint."""
    for batch in batches:
        for own, texts in zip(resemblance.marks([batch]), row_slices([batch], 2)):
            prints = np.array([fingerprint(t) for t in texts.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*own.columns[:3], pa.array(prints), own.column(3)], ["id", "digest", "mark", "print", "minima"])


def _print_links(marked: DataFrame) -> DataFrame:
    """(a, b): links between the ``mark`` values whose ``print`` differ in at most ``BITS`` bits. Marks
    of one fingerprint hang on the smallest of them, which meets those of linked fingerprints."""
    prints = materialize(marked.groupBy("print").agg(F.min("mark").alias("low"), F.max("mark").alias("high")), "prints")
    shared = small_or_plain(
        materialize(prints.where("low < high").select(F.col("print").alias("p"), "low"), "shared"), F.lit(16))
    same = marked.select("mark", "print").distinct().join(shared, F.col("print") == F.col("p")).where("mark != low").select(
        F.col("low").alias("a"), F.col("mark").alias("b"))
    met = materialize(links(prints.select(F.col("print").alias("mark"))), "print-links")
    one, two = (prints.select(F.col("print").alias(p), F.col("low").alias(m)) for p, m in (("p", "m"), ("q", "n")))
    across = met.join(one, F.col("a") == F.col("p")).join(two, F.col("b") == F.col("q")).where("m != n").select(
        F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"))
    return same.unionByName(across)


def _decided(rows: DataFrame, similarity: float, exact: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Of ``rows`` (id, digest, text): the (id, digest) that go, those that stay but are repeated,
    and where these two tables are."""
    with batches_of(rows.sparkSession, TEXT_ROWS):
        marked = materialize(arrow_map(rows, _marks, "id bigint, digest bigint, mark bigint, print bigint, minima binary"), "marked")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    points = materialize(marked.groupBy("mark").agg(F.min(row).alias("row"), F.first("minima").alias("minima")), "points")

    def texts_of(wanted: DataFrame) -> DataFrame:
        some = materialize(points.join(wanted.withColumnRenamed("mark", "m"), F.col("mark") == F.col("m"), "left_semi").select(
            "mark", F.col("row.id").alias("its"), F.col("row.digest").alias("hash")), "wanted")
        met = rows.join(small_or_plain(some, F.lit(32)), F.col("id").eqNullSafe(F.col("its")) & (F.col("digest") == F.col("hash")))
        # Repeated rows of the same id and text are one.
        return met.groupBy("mark").agg(F.first("text").alias("text"))

    alike = _print_links(marked).unionByName(resemblance.resembling(points.select("mark", "minima"), texts_of, similarity, exact))
    roots = components(materialize(alike, "links"), "links")
    classed = points.select("mark", "row").join(roots, F.col("mark") == F.col("node"), "left").select(
        "row", "mark", F.coalesce("root", "mark").alias("root"))
    best = materialize(classed.groupBy("root").agg(F.min(F.struct("row.none", "row.id", "mark", "row.digest")).alias("b")).select(
        F.col("b.id").alias("its"), F.col("b.digest").alias("hash")), "best")
    chosen = F.col("id").eqNullSafe(F.col("its")) & (F.col("digest") == F.col("hash"))
    # What goes is told by distinct (id, text hash); mostly that is less than what stays.
    gone, gone_path = materialize(
        marked.select("id", "digest").distinct().join(best, chosen, "left_anti"), "gone", with_path=True)
    repeated, repeated_path = materialize(
        marked.join(best, chosen, "left_semi").groupBy("id", "digest").count().where("count > 1"), "repeated", with_path=True)
    return gone, repeated, [gone_path, repeated_path]


def _without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, own: Column, digest: Column) -> DataFrame:
    """``docs`` without the rows ``gone`` (id, digest), and one of each of the rows ``repeated``."""
    own_name, digest_name = unused(docs, "own"), unused(docs, "digest")
    named = docs.withColumns({own_name: own, digest_name: digest})

    def side(df: DataFrame) -> tuple[DataFrame, Column]:
        other_id, other_digest = unused(named, "other"), unused(named, "hash")
        side = small_or_plain(df.select(F.col("id").alias(other_id), F.col("digest").alias(other_digest)), F.lit(16))
        return side, F.col(own_name).eqNullSafe(F.col(other_id)) & (F.col(digest_name) == F.col(other_digest))

    kept = named.join(*side(gone), "left_anti")
    if not repeated.isEmpty():
        # They alone are brought together.
        some = kept.join(*side(repeated), "left_semi").dropDuplicates([own_name, digest_name])
        kept = kept.join(*side(repeated), "left_anti").unionByName(some)
    return kept.drop(own_name, digest_name)


def hex_mark(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), 16, "0")


def op1_simhash(spark, folder):
    rows = near_copies(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select(
        F.col("id").alias("doc_id"), hex_mark(F.col("mark")).alias("fingerprint"),
        F.col("class_id").alias("component_id"))
