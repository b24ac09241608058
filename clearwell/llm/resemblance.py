"""Links between texts that share most of their shingles.

The resemblance of two texts is the Jaccard index of their sets of shingles (five words).
Candidates come from ``MINIMA`` = 128 min-hashes: ``BANDS`` = 32 keys of ``ROWS`` = 4 minima each.
Texts of resemblance 0.8 have no key in common once in 20 million pairs. Of the candidates, those
go on whose minima agree in a share not more than four deviations below the wanted resemblance (a
pair at 0.8 is lost once in 30,000); these are verified on their whole sets.

Texts of equal sets are one point, so copies, however many, are met once. Of a bucket (the
points of one key) every point first meets the smallest only, which joins a large group of near copies
without its pairs; so it does in the first divisions, and where dividing ends. Buckets of one class are then done. In others all
pairs across classes are met while the bucket is small. A crowded bucket, say texts around one
passage that do not resemble by themselves, is no table of pairs: up to ``GATHERED`` points come
together in a task with their sets (of a large one the ``SET`` least shingles), whose pairs across classes are one
product of matrices; only those that resemble leave it. A larger one is divided first: each of its points goes to
``TRIES`` = 4 smaller buckets by eight minima more, and so on, so the pairs of a crowd are never
formed and work grows with the points. ``exact=True`` forms them instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.packaging import ship
from ..functions.storage import drop_table, materialize, scratch
from .common import UINT, arrow_map, batches_of, components, gram_hashes, mix, row_slices, word_hashes

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
# A division: so many buckets for each point, each by so many minima more.
TRIES, DEEPER = 4, 8
# Points of a bucket whose pairs are formed, and of one that a task compares by the sets of its points,
# each of at most so many shingles; larger buckets are divided, at most so often.
CROWD = 16
GATHERED, SET = 2048, 512
LEVELS = 8
# Pairs for each point of the table that are formed at once, however crowded the buckets left.
PAIRS = 1
CHUNK = 1024
# Sets of a bucket that are compared with all of it at a time.
ROWS_AT_ONCE = 256
# Pairs of texts that Python holds at a time.
TEXT_ROWS = 1_000
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_draw = np.random.default_rng(42)
_XOR, _TIMES = _draw.integers(0, 1 << 64, (2, MINIMA, 1), UINT, endpoint=False)
_TIMES |= UINT(1)
_JOIN = _draw.integers(0, 1 << 64, DEEPER, UINT, endpoint=False) | UINT(1)


# -- one text ---------------------------------------------------------------- #


def shingles(text: str | None, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of ``k`` words in a row, lower-cased; of fewer words the
    hash of all. None without words."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, UINT)
    k = min(k, len(starts))
    words = word_hashes(data.astype(np.uint16) + np.uint16(1), starts, ends)
    return np.unique(gram_hashes(words, k)[: len(words) - k + 1])


def set_mark(grams: np.ndarray) -> int:
    """A 64-bit number of the whole set; 0 for the empty one."""
    return int(mix(grams ^ UINT(0x5851F42D4C957F2D)).sum(dtype=UINT))


def minima(grams: np.ndarray) -> bytes:
    """16 bits of each of the ``MINIMA`` min-hashes; nothing for the empty set."""
    if not len(grams):
        return b""
    least = np.full(MINIMA, np.iinfo(UINT).max, UINT)
    for at in range(0, len(grams), CHUNK):
        np.minimum(least, ((grams[at : at + CHUNK] ^ _XOR) * _TIMES).min(axis=1), out=least)
    return mix(least).astype("<u2").tobytes()


def rows_of(paths: np.ndarray, level: int) -> np.ndarray:
    """The ``DEEPER`` minima by which each of ``paths`` of ``level`` divides the bucket above. Bands
    have the paths 0 to ``BANDS`` - 1; the divisions of ``p`` are ``TRIES * p`` and on."""
    mixed = mix(paths.astype(UINT) * UINT(LEVELS) + UINT(level)).astype(np.int64) & 0x3FFF
    start, stride = mixed % MINIMA, (mixed // MINIMA) | 1
    return (start[:, None] + stride[:, None] * np.arange(DEEPER)) % MINIMA


def _keys(above: np.ndarray, values: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """The keys of some minima (one row each) within the buckets ``above``."""
    return mix((values.astype(UINT) + UINT(1)) @ _JOIN[: values.shape[1]] + mix(above + UINT(1)) + mix(paths.astype(UINT)))


# -- in a task --------------------------------------------------------------- #


def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, text) -> (id, digest, mark, minima)."""
    for batch in row_slices(batches, 2):
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.array([set_mark(s) for s in sets], UINT).view(np.int64)),
             pa.array([minima(s) for s in sets], pa.binary())], ["id", "digest", "mark", "minima"])


_MEMBERS = "key bigint, path bigint, mark bigint"


def _members(keys: np.ndarray, paths: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(paths.astype(np.int64)), pa.array(owners)], ["key", "path", "mark"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u2")
    return flat.reshape(-1, MINIMA)


def _bands(batches):
    """(mark, minima) -> the members of all bands."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            values = _matrix(some.column(1)).reshape(-1, BANDS, ROWS)
            paths = np.tile(np.arange(BANDS), len(values))
            keys = _keys(np.zeros(len(paths), UINT), values.reshape(-1, ROWS), paths)
            yield _members(keys, paths, np.repeat(some.column(0).to_numpy(zero_copy_only=False), BANDS))


def _divided(level: int):
    """(mark, minima, buckets) -> the members of their divisions, which are of ``level``."""

    def run(batches):
        for batch in batches:
            for mark, least, buckets in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), batch.column(2)):
                above = np.repeat(buckets.values.field("key").to_numpy(zero_copy_only=False), TRIES)
                paths = (buckets.values.field("path").to_numpy(zero_copy_only=False)[:, None] * TRIES + np.arange(TRIES)).reshape(-1)
                values = least[rows_of(paths, level)]
                yield _members(_keys(above.astype(np.int64).view(UINT), values, paths), paths, np.full(len(paths), mark, np.int64))

    return run


def _alike(least: float):
    """(a, b, minima of each) -> the pairs whose minima agree in a share of ``least``."""

    def run(batches):
        for batch in batches:
            share = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
            yield batch.select([0, 1]).filter(pa.array(share >= least))

    return run


def _resembling(similarity: float):
    """(a, b, text of each) -> the pairs whose sets of shingles resemble."""

    def run(batches):
        for batch in row_slices(batches, 2):
            fine, last, x = [], None, None
            for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x is None or a != last:
                    x, last = shingles(s), a
                y = shingles(t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    return run


def _sets(batches):
    """(mark, text) -> (mark, whole, grams): the sorted ``SET`` least shingles, and if that is all."""
    for batch in row_slices(batches, 1):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) <= SET for s in sets]), pa.array([s[:SET].tobytes() for s in sets], pa.binary())],
            ["mark", "whole", "grams"])


def shared_grams(sets: list[np.ndarray], some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of ``some`` numbers of ``sets``: how many elements each of these shares with each of all."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Elements of one set only are shared by none.
    column, shared = (np.cumsum(times > 1) - 1)[gram], times[gram] > 1
    order = np.argsort(column[shared], kind="stable")
    owner, column = owner[shared][order], column[shared][order]
    for start in range(0, len(some), ROWS_AT_ONCE):
        rows = some[start : start + ROWS_AT_ONCE]
        both = np.zeros((len(rows), len(sets)), np.float32)
        for at in range(0, int((times > 1).sum()), CHUNK):
            low, high = np.searchsorted(column, (at, at + CHUNK))
            has = np.zeros((len(sets), CHUNK), np.float32)
            has[owner[low:high], column[low:high] - at] = 1
            both += has[rows] @ has.T
        yield rows, both.astype(np.int64)


def _gathered(similarity: float):
    """A bucket (mark, class, whole, grams) -> (a, b, sure): pairs across classes that resemble (of sets
    that are whole, a forest of them), and those of which the least shingles cannot tell."""

    def run(bucket: pa.Table) -> pa.Table:
        mark, kind, whole = (bucket.column(c).to_numpy() for c in ("mark", "class", "whole"))
        sets = [np.frombuffer(g, UINT) for g in bucket.column("grams").to_pylist()]
        names, number, times = np.unique(kind, return_inverse=True, return_counts=True)
        root = list(range(len(names)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        # Sets are compared as far as both are known: below the least of their last shingles.
        reach = np.array([np.iinfo(UINT).max if w else s[-1] for w, s in zip(whole, sets)], UINT)
        fine, unsure = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        # Every pair across classes has an end outside the largest class.
        for rows, both in shared_grams(sets, np.flatnonzero(number != times.argmax())):
            of = np.stack([np.searchsorted(sets[i], reach, "right") for i in rows])
            of += np.stack([np.searchsorted(s, reach[rows], "right") for s in sets], axis=1) - both
            known = whole[rows][:, None] & whole
            least = similarity - np.where(known, 0, 4 * (similarity * (1 - similarity) / np.maximum(of, 1)) ** 0.5)
            x, y = np.nonzero((both >= least * of) & (number[rows][:, None] != number))
            pairs = np.stack([rows[x], y], axis=1)
            unsure.append(pairs[~known[x, y]])
            for a, b in pairs[known[x, y]].tolist():
                i, j = top(number[a]), top(number[b])
                if i != j:
                    root[i] = j
                    fine.append(np.array([[a, b]]))
        tops = np.array([top(i) for i in range(len(names))])[number]
        pairs = np.concatenate(unsure)
        # What the sure links join needs no other.
        pairs = pairs[tops[pairs[:, 0]] != tops[pairs[:, 1]]]
        links = np.concatenate(fine)
        a, b = mark[np.concatenate([links, pairs])].T
        return pa.table({
            "a": np.minimum(a, b), "b": np.maximum(a, b), "sure": np.arange(len(a)) < len(links)})

    return run


# -- over the table ---------------------------------------------------------- #


def _paired(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
    """(a, b, x, y): ``pairs`` with the column ``what`` of both marks."""
    of = side.select(F.col("mark").alias("m"), F.col(what).alias("x"))
    and_of = side.select(F.col("mark").alias("n"), F.col(what).alias("y"))
    return pairs.join(of, F.col("a") == F.col("m")).join(and_of, F.col("b") == F.col("n")).select("a", "b", "x", "y")


def _compared(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure): what ``_gathered`` finds in the buckets of ``members`` (key, mark, class)."""
    ship(members.sparkSession)
    full = members.join(sets.withColumnRenamed("mark", "m"), F.col("mark") == F.col("m")).select(
        "key", "mark", "class", "whole", "grams")
    return full.groupBy("key").applyInArrow(_gathered(similarity), "a bigint, b bigint, sure boolean").distinct()


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def resembling(
    points: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, exact: bool = False,
) -> DataFrame:
    """(a, b) with a < b: links between the ``mark`` values of ``points`` (mark, minima), a written
    table without repeated marks, whose sets resemble by ``similarity`` (at least 0.8). What all such
    pairs reach, these reach, but for pairs that share no bucket; ``texts_of`` gives (mark, text) for a
    table of marks. ``exact``: no bucket is divided and no pair is left out for its minima, so
    only pairs without any key in common are missed, and the work grows with the square of a crowd."""
    if similarity < SIMILARITY:
        raise ValueError("the bands are laid out for a similarity of 0.8 and more")
    deviation = (similarity * (1 - similarity) / MINIMA) ** 0.5
    spark = points.sparkSession
    some = points.where("octet_length(minima) > 0").select("mark", "minima")

    def verified(pairs: DataFrame) -> DataFrame:
        if not exact:
            pairs = arrow_map(_paired(pairs, some, "minima"), _alike(similarity - 4 * deviation), "a bigint, b bigint")
        with scratch(spark) as keep, batches_of(spark, TEXT_ROWS):
            near = materialize(pairs, "alike")
            texts = materialize(texts_of(near.select(F.explode(F.array("a", "b")).alias("mark")).distinct()), "texts")
            found, path = materialize(
                arrow_map(_paired(near, texts, "text"), _resembling(similarity), "a bigint, b bigint"), "links", with_path=True)
            keep(path)
        return found

    links, met, rest = [], [], []
    count = some.count()
    members, path = materialize(
        arrow_map(some, _bands, _MEMBERS).withColumn("class", F.col("mark")), "members", with_path=True)
    for level in range(LEVELS):
        # A bucket's classes are those known when it was made; at first each point is one, and numbers need no sort.
        low = F.min("class") if level == 0 else F.min(F.struct("class", "mark"))
        least = F.struct(F.col("low").alias("class"), F.col("low").alias("mark")) if level == 0 else F.col("low")
        ends = materialize(members.groupBy("key").agg(low.alias("low"), F.max("class").alias("high")).select(
            F.col("key").alias("at"), least.alias("low"), "high").where("low.class < high").drop("high"), "ends")
        if ends.isEmpty():
            break
        # Most members are alone in their bucket; from here on only the others are read.
        inside, inside_path = materialize(members.join(ends, F.col("key") == F.col("at")).drop("at"), "inside", with_path=True)
        drop_table(spark, path)
        path = inside_path
        if level in (0, 1, LEVELS - 1):
            star = materialize(
                inside.where("class != low.class").select(*_ordered("mark", "low.mark")).distinct(), "star")
            met.append(star)
            links.append(verified(star))
            roots = components(reduce(DataFrame.unionByName, links), "links")
        # Buckets that are still of several classes: their pairs across classes, or their divisions.
        classed = materialize(
            inside.join(roots, F.col("mark") == F.col("node"), "left").select(
                "key", "path", "mark", F.coalesce("root", "mark").alias("class")), "classed")
        mixed = materialize(classed.groupBy("key").agg(
            F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select(
            F.col("key").alias("at"), "n"), "mixed")
        left_pairs = mixed.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
        formed = exact or left_pairs <= PAIRS * count
        way = F.lit("formed") if formed else F.when(F.col("n") <= CROWD, "formed").when(F.col("n") <= GATHERED, "gathered").otherwise(
            "formed" if level == LEVELS - 1 else "divided")
        placed = materialize(classed.join(mixed.select("at", way.alias("way")), F.col("key") == F.col("at")).drop("at"), "placed")
        few = placed.where("way = 'formed'")
        other = few.select(F.col("key").alias("at"), F.col("mark").alias("other"), F.col("class").alias("its"))
        rest.append(materialize(few.join(other, (F.col("key") == F.col("at")) & (F.col("class") < F.col("its"))).select(
            *_ordered("mark", "other")).distinct(), "rest"))
        whole = placed.where("way = 'gathered'")
        if not formed and not whole.isEmpty():
            with batches_of(spark, TEXT_ROWS):
                sets = materialize(
                    arrow_map(texts_of(whole.select("mark").distinct()), _sets, "mark bigint, whole boolean, grams binary"), "sets")
            compared = materialize(_compared(whole, sets, similarity), "compared")
            links.append(compared.where("sure").select("a", "b"))
            rest.append(compared.where("not sure").select("a", "b"))
        buckets = placed.where("way = 'divided'").groupBy("mark").agg(
            F.first("class").alias("class"), F.collect_list(F.struct("key", "path")).alias("buckets"))
        buckets = materialize(buckets, "buckets")
        if buckets.isEmpty():
            break
        found = arrow_map(
            buckets.join(some.withColumnRenamed("mark", "m"), F.col("mark") == F.col("m")).select("mark", "minima", "buckets"),
            _divided(level + 1), _MEMBERS)
        classes = buckets.select(F.col("mark").alias("m"), "class")
        divided, new_path = materialize(found.join(classes, F.col("mark") == F.col("m")).drop("m"), "members", with_path=True)
        drop_table(spark, path)
        members, path = divided, new_path
    if not links:
        return some.select(F.col("mark").alias("a"), F.col("mark").alias("b")).limit(0)
    tested = reduce(DataFrame.unionByName, met).select(F.col("a").alias("p"), F.col("b").alias("q")).distinct()
    left = reduce(DataFrame.unionByName, rest).distinct().join(
        tested, (F.col("a") == F.col("p")) & (F.col("b") == F.col("q")), "left_anti")
    return reduce(DataFrame.unionByName, links).unionByName(verified(left))
