"""Exact search for the highest inner products with an impact-ordered index.

Vectors become integers, ``floor(1024 * x)``, and lie in blocks of bounded size. A block is indexed once,
in a written table: for every dimension, level and sign, the rows whose component quantised to a
multiple of 1/``LEVELS`` of the block's largest (its impact) has that level form a posting segment.
Segments are processed score at a time, large impacts first: a query multiplies its component with the
impact once and adds the product to the rows of the segment. After each level, what is still
unprocessed of a row is known in length, so its score lies within |query| x |rest| of the sum so far. A
query stops when that proves that few rows can be among its best; these are scored again exactly. A
query that is never proven is rescored over all that remain possible after the last segment.

Blocks stay where they are: queries come to them in rounds of bounded size, as a broadcast. A task keeps
the best of each query over all its blocks, which also raises the bar for the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.storage import materialize
from .common import arrow_map

SCALE = 1024
BLOCK = 2048
LEVELS = 16
# Bytes of queries that go to all tasks in one round.
ROUND_BYTES = 16 << 20
# Rows per query that are rescored rather than narrowed further.
FEW = 48


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of floor(SCALE * x); shorter vectors are filled up with 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), max(1, sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(SCALE * flat.astype(np.float64))
    return out


_INDEX = "ids binary, width int, vectors binary, dims binary, impacts binary, ends binary, rows binary, levels binary, rests binary"


def _indexed(rows_per_block: int):
    """(id, vector) -> one line per block: its rows and its index."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(at, rows_per_block)
                matrix = _matrix(pa.concat_arrays([part.column(1)]))
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                stored = [ids, matrix.shape[1], matrix, *ImpactIndex.build(matrix).parts()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int32()) if isinstance(x, int) else pa.array([x.tobytes()], pa.binary()) for x in stored],
                    [c.split()[0] for c in _INDEX.split(", ")])

    return run


class ImpactIndex:
    """The posting segments of one block, large impacts first: segment s belongs to dimension
    ``dims[s]``, adds ``impacts[s]`` (with its sign) and holds ``rows[ends[s - 1] : ends[s]]``. The
    segments of level l end at ``levels[l]``, l counted from the largest; ``rests[l]`` are the lengths
    of what each row then has left."""

    def __init__(self, dims, impacts, ends, rows, levels, rests):
        self.dims, self.impacts, self.ends, self.rows, self.levels, self.rests = dims, impacts, ends, rows, levels, rests
        self.multiplied = 0  # by all searches so far

    @classmethod
    def build(cls, vectors: np.ndarray) -> ImpactIndex:
        size = np.abs(vectors)
        step = max(1.0, np.ceil(size.max(initial=0) / LEVELS))
        level = np.minimum(np.floor(size / step), LEVELS).astype(np.int64)
        row, dim = np.nonzero(level)
        negative = vectors[row, dim] < 0
        # By level from the largest, then dimension, then sign.
        segment = ((LEVELS - level[row, dim]) * vectors.shape[1] + dim) * 2 + negative
        order = np.argsort(segment, kind="stable")
        kinds, starts = np.unique(segment[order], return_index=True)
        dims, of = (kinds // 2) % vectors.shape[1], LEVELS - kinds // 2 // vectors.shape[1]
        impacts = of * step * np.where(kinds % 2 == 1, -1.0, 1.0)
        levels = np.searchsorted(-of, -np.arange(LEVELS, 0, -1), "right")
        rests, rest = [], vectors.copy()
        for l in range(LEVELS, 0, -1):
            at = level == l
            rest[at] -= np.sign(vectors[at]) * l * step
            rests.append(np.sqrt((rest**2).sum(axis=1)))
        return cls(dims.astype(np.int32), impacts, np.append(starts[1:], len(row)).astype(np.int64)[: len(kinds)], row[order].astype(np.int32),
                   levels.astype(np.int64), np.array(rests).reshape(LEVELS, len(vectors)))

    def parts(self) -> list[np.ndarray]:
        return [self.dims, self.impacts, self.ends, self.rows, self.levels, self.rests]

    @classmethod
    def stored(cls, line: dict) -> ImpactIndex:
        kinds = {"dims": np.int32, "impacts": np.float64, "ends": np.int64, "rows": np.int32, "levels": np.int64, "rests": np.float64}
        parts = {c: np.frombuffer(line[c], k) for c, k in kinds.items()}
        return cls(**parts | {"rests": parts["rests"].reshape(LEVELS, -1)})

    def search(self, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, bar: np.ndarray):
        """Yields (query, rows, scores): the rows among which each query's best k of the block are, with
        their scores, but for rows that are below ``bar``, the k-th score that it has already. ``own``
        are the ids that the queries must not meet."""
        n, width = vectors.shape
        length = np.sqrt((queries**2).sum(axis=1))
        open_ = np.arange(len(queries))
        sums = np.zeros((n, len(queries)))
        mine = ids[:, None] == own[None, :]
        first = 0
        for number in range(LEVELS):
            last, rest = int(self.levels[number]), self.rests[number]
            for s in range(first, last):
                rows = self.rows[self.ends[s - 1] if s else 0 : self.ends[s]]
                sums[rows] += queries[open_, self.dims[s]] * self.impacts[s]
            self.multiplied += (last - first) * len(open_)
            if last == first and number < LEVELS - 1:
                continue
            first = last
            # 1e-6: more than what the square roots can be off by.
            slack = rest[:, None] * (length[open_] * (1 + 1e-9)) + 1e-6
            self.multiplied += slack.size
            known = bar[open_]
            if not np.isfinite(known).all() and n > k:
                low = np.where(mine, -np.inf, sums - slack)
                known = np.maximum(known, np.partition(low, n - k, axis=0)[n - k])
            possible = (sums + slack >= known) & ~mine
            done = (possible.sum(axis=0) <= FEW) | (number == LEVELS - 1)
            for at in np.flatnonzero(done):
                rows = np.flatnonzero(possible[:, at])
                self.multiplied += len(rows) * width
                yield open_[at], rows, vectors[rows] @ queries[open_[at]]
            open_, sums, mine = open_[~done], sums[:, ~done], mine[:, ~done]
            if not len(open_):
                break


def _exact_search(vectors, queries, own, ids):
    """For components so large that sums leave the exact range of doubles."""
    whole = np.vectorize(int, otypes=[object])(vectors)
    for q, vector in enumerate(np.vectorize(int, otypes=[object])(queries)):
        rows = np.flatnonzero(ids != own[q])
        yield q, rows, whole[rows] @ vector if len(rows) else np.zeros(0, object)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.bar = np.full(queries, -np.inf)

    def add(self, query: int, scores, ids) -> None:
        now = self.found[query]
        now += [(-int(s), int(i)) for s, i in zip(scores, ids)]
        now.sort()
        del now[self.k :]
        if len(now) == self.k:
            self.bar[query] = float(-now[-1][0])


def _met(asked, k: int):
    """Blocks -> (query_id, vec_id, score), the best k of the task for each query of the broadcast."""

    def run(batches):
        own, queries = asked.value
        best = _Best(len(own), k)
        for batch in batches:
            for line in batch.to_pylist():
                ids = np.frombuffer(line["ids"], np.int64)
                vectors = np.frombuffer(line["vectors"], np.float64).reshape(len(ids), line["width"])
                width = max(line["width"], queries.shape[1])
                wide = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                if np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * width < 2.0**52:
                    met = ImpactIndex.stored(line).search(vectors, wide[:, : line["width"]], own, ids, k, best.bar)
                else:
                    met = _exact_search(vectors, wide[:, : line["width"]], own, ids)
                for q, rows, scores in met:
                    best.add(q, scores, ids[rows])
        out = [[], [], []]
        for q, found in enumerate(best.found):
            out[0] += [own[q]] * len(found)
            out[1] += [i for _, i in found]
            out[2] += [-s for s, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the ``k`` rows of ``vectors`` with the
    highest integer inner product, ties to the smaller id; rows of the query's own id do not
    count. Exact, so recall is 1.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component,
    take no part. Vectors of different lengths meet as if filled up with 0. Repeated rows
    are candidates each; a repeated query id counts once, with its smallest vector. Fewer
    than ``k`` candidates: all of them; an empty table: no row. Other columns are not read."""
    spark = vectors.sparkSession

    def clean(df):
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
            F.col("id").isNotNull() & usable(F.col("v")))

    index = materialize(arrow_map(clean(vectors), _indexed(BLOCK), _INDEX), "impact-index")
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "queries")
    count, longest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rounds = max(1, -(-count * (longest + 1) * 8 // ROUND_BYTES))
    found = None
    for number in range(rounds):
        # One round of queries, some ROUND_BYTES, comes to the driver and goes to all tasks.
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number).toArrow()
        own = some.column("id").to_numpy().astype(np.int64)
        matrix = _matrix(some.column("v").combine_chunks()) if len(own) else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast((own, matrix))
        best = arrow_map(index, _met(sent, k), "query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if rounds > 1:
            best = materialize(best, "round")
            sent.destroy()
        found = best if found is None else found.unionByName(best)
    return found


def op8_topk(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 100 = 0),
s as (
  select q.vec_id query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) as bigint) score
  from q join v on q.vec_id <> v.vec_id)
select query_id, cast(rank as int) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 10
"""
