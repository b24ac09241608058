"""Pairwise-complete Pearson correlation of many columns, by masked matrix products."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import stats
from .packaging import ship

# Columns whose products are taken together, and rows that a middle value is taken from.
BLOCK = 512
PILOT = 1_000
# How much larger the squared distance of a mean from the middle value may be than the variance.
SHIFTED = 1e6
_PARTS = ("n", "mean_x", "mean_y", "sxx", "syy", "sxy", "low_x", "high_x", "low_y", "high_y")


def pearson(x: Column, y: Column) -> Column:
    """NULL where either side is constant or fewer than two pairs are complete. The
    built-in ``corr`` would divide by zero there."""
    return F.try_divide(
        F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    )


def _pair_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_PARTS`` of two columns without gaps; sums are of differences from the means."""
    mean_x, mean_y = x.mean(), y.mean()
    dx, dy = x - mean_x, y - mean_y
    return np.array([len(x), mean_x, mean_y, dx @ dx, dy @ dy, dx @ dy, x.min(), x.max(), y.min(), y.max()])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_PARTS`` of two sets of rows together."""
    n = a[0] + b[0]
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return np.array([
        n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n,
        a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight,
        min(a[6], b[6]), max(a[7], b[7]), min(a[8], b[8]), max(a[9], b[9]),
    ])


def _task_parts(pairs: list[tuple[int, int]]):
    """One row per pair and task; each pair is taken on its common rows, so that a value without
    its partner cannot blur it."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                cells = _cells(batch)
                held = ~np.isnan(cells)
                for i, j in pairs:
                    both = held[:, i] & held[:, j]
                    if both.any():
                        parts = _pair_parts(cells[both, i], cells[both, j])
                        sums[i, j] = _merge(sums[i, j], parts) if (i, j) in sums else parts
        if sums:
            table = np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in sums], pa.int32()), pa.array([p[1] for p in sums], pa.int32()),
                 *[pa.array(table[:, k]) for k in range(len(_PARTS))]],
                ["i", "j", *_PARTS])

    return run


def _cells(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns, NaN for a gap."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])


# Products of a task, each a matrix over pairs of columns on their common rows: rows, sums of the first
# column, of its squares, of products, and cells of the first that are not finite.
_PRODUCTS = ("rows", "total", "squares", "products", "odd")


def _products(middle: np.ndarray):
    width = len(middle)

    def run(batches):
        sums = np.zeros((len(_PRODUCTS), width, width))
        with np.errstate(all="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = _cells(batch)
                held = ~np.isnan(cells)
                odd = np.isinf(cells)
                value = np.where(held & ~odd, cells - middle, 0.0)
                mask = held.astype(np.float64)
                sums[0] += mask.T @ mask
                sums[1] += value.T @ mask
                sums[2] += (value * value).T @ mask
                sums[3] += value.T @ value
                if odd.any():
                    sums[4] += odd.astype(np.float64).T @ mask
        yield _lines(np.arange(width), sums.transpose(1, 0, 2).reshape(width, -1))

    return run


def _lines(number: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(number.astype(np.int32)), pa.array(list(values), pa.list_(pa.float64()))], ["line", "sums"])


def _added(batches):
    """The sums of equal lines of all tasks."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for line, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = row.values.to_numpy(zero_copy_only=False)
            found[line] = found[line] + values if line in found else values.copy()
    if found:
        yield _lines(np.array(list(found)), np.array(list(found.values())))


def _from_products(data: DataFrame, columns: list[int]) -> tuple[dict[tuple[int, int], float | None], list[tuple[int, int]]]:
    """(r of pairs, pairs that need a closer look); pairs are of ``columns``, those of ``data``."""
    width, schema = len(columns), "line int, sums array<double>"
    # Any value near the others will do, so some rows are enough.
    some = data.limit(PILOT).toPandas().to_numpy(dtype=float, na_value=np.nan)
    some[~np.isfinite(some)] = np.nan
    middle = np.array([np.nanmedian(c) if not np.isnan(c).all() else 0.0 for c in some.T])
    lines = data.mapInArrow(_products(middle), schema)
    shuffles = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = np.zeros((len(_PRODUCTS), width, width))
    for r in lines.repartition(min(width, shuffles), "line").mapInArrow(_added, schema).collect():  # a line per column
        sums[:, r["line"]] = np.reshape(r["sums"], (len(_PRODUCTS), width))
    rows, total, squares, products, odd = sums
    with np.errstate(all="ignore"):
        shift = total * total / rows
        spread = squares - shift
        together = products - total * total.T / rows
        r = np.clip(together / (np.sqrt(spread) * np.sqrt(spread.T)), -1.0, 1.0)
        constant = squares == 0
        sure = (spread * SHIFTED > shift) & np.isfinite(squares) & (odd == 0)
    found, unsure = {}, []
    for p, i in enumerate(columns):
        for q in range(p + 1, width):
            pair = i, columns[q]
            if rows[p, q] < 2:
                found[pair] = None
            elif odd[p, q] == 0 == odd[q, p] and (constant[p, q] or constant[q, p]):
                found[pair] = None
            elif sure[p, q] and sure[q, p]:
                found[pair] = float(r[p, q])
            else:
                unsure.append(pair)
    return found, unsure


def _from_pairs(data: DataFrame, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], float | None]:
    """r of the ``pairs``: each task sums products of differences from its own means, and tasks are
    put together with the differences of their means, so nothing is lost to large numbers far
    from zero."""
    used = sorted({i for pair in pairs for i in pair})
    place = {i: k for k, i in enumerate(used)}
    schema = "i int, j int, " + ", ".join(f"{p} double" for p in _PARTS)
    parts = data.select([f"c{i}" for i in used]).mapInArrow(_task_parts([(place[i], place[j]) for i, j in pairs]), schema)
    n, zero = F.col("n"), F.lit(0.0)
    start = F.struct(*[zero.alias(p) for p in ("n", "mean_x", "mean_y", "sxx", "syy", "sxy")])

    def joined(t, p):
        total = t["n"] + p["n"]
        dx, dy, weight = p["mean_x"] - t["mean_x"], p["mean_y"] - t["mean_y"], t["n"] * p["n"] / total
        return F.struct(
            total.alias("n"), (t["mean_x"] + dx * p["n"] / total).alias("mean_x"), (t["mean_y"] + dy * p["n"] / total).alias("mean_y"),
            (t["sxx"] + p["sxx"] + dx * dx * weight).alias("sxx"), (t["syy"] + p["syy"] + dy * dy * weight).alias("syy"),
            (t["sxy"] + p["sxy"] + dx * dy * weight).alias("sxy"))

    moved = F.collect_list(F.struct(n, "mean_x", "mean_y", "sxx", "syy", "sxy"))
    # Two levels: a list holds one row of every 256th task, then at most 256.
    level = parts.withColumn("half", F.pmod(F.spark_partition_id(), F.lit(256)))
    for keys in (["i", "j", "half"], ["i", "j"]):
        level = level.groupBy(*keys).agg(
            F.aggregate(moved, start, joined).alias("s"), F.min("low_x").alias("low_x"), F.max("high_x").alias("high_x"),
            F.min("low_y").alias("low_y"), F.max("high_y").alias("high_y"),
        ).select(*keys, "s.*", "low_x", "high_x", "low_y", "high_y")
    r = F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    r = F.when(~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    varied = (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y"))
    rows = level.select("i", "j", F.when(varied, r).alias("r")).collect()  # one per pair
    return dict.fromkeys(pairs) | {(used[row["i"]], used[row["j"]]): row["r"] for row in rows}


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """r for each pair of columns, each pair once, in column order; None where a column is
    constant on the rows that hold both, or fewer than two do.

    One scan for up to ``BLOCK`` columns (beyond it one for each two blocks): tasks add up matrix
    products of masks, values and squares, as differences from a middle value of each column, and
    lines of these matrices are added up over tasks. Pairs for which those differences are large
    against their spread on common rows, or not finite, would lose digits; they alone are summed
    again in a second scan, from their own means."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    result: dict[tuple[str, str], float | None] = dict.fromkeys(pairs)
    if not pairs:
        return result
    spark = df.sparkSession
    ship(spark)
    data = df.select([stats.as_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    blocks = [range(at, min(at + BLOCK, len(columns))) for at in range(0, len(columns), BLOCK)]
    doubtful = []
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            wanted = sorted({*left, *right})
            found, unsure = _from_products(data.select([f"c{i}" for i in wanted]), wanted)
            result.update({(columns[i], columns[j]): r for (i, j), r in found.items()})
            doubtful += unsure
    if doubtful:
        result.update({(columns[i], columns[j]): r for (i, j), r in _from_pairs(data, sorted(set(doubtful))).items()})
    return result
