"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and the beginnings of its words (4 to 8 bytes), hashed to
2^18 numbers. The score is the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j:
the pair part learns what only matters together, as an insult next to a group, which a
linear model cannot. The pair sum costs one pass per factor:
1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2).

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows (a documented bound; rows are
drawn by a hash of their id, the same at any table size) and at most ``TERMS`` terms, those
with the highest chi-square against the label. Scoring covers all rows and whole texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.storage import materialize
from .common import UINT, arrow_map, text_slices, word_hashes, word_spans

SAMPLE_ROWS = 16_000
HASH_BITS = 18
TERMS = 2048
PREFIXES = (4, 5, 6, 7, 8)
FACTORS = 4
EPOCHS = 25
MAX_COUNT = 15
LEAST_TEXTS = 4


def term_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) for every word and word beginning of the texts."""
    low, starts, ends, first = word_spans(data, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    texts, codes = [text], [word_hashes(low, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        texts.append(text[long])
        codes.append(word_hashes(low, starts[long], starts[long] + k) ^ UINT(k << 40))
    return np.concatenate(texts), (np.concatenate(codes) >> UINT(64 - HASH_BITS)).astype(np.int64)


def _counted(text: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, counts = np.unique(text * width + code, return_counts=True)
    return pairs // width, pairs % width, counts


def _term_texts(batches):
    """Per task: in how many texts of either label each term stands."""
    sums = np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        for rows, data, offsets in text_slices(batch, 1):
            toxic = rows.column(2).to_numpy(zero_copy_only=False)
            text, code, _ = _counted(*term_codes(data, offsets), 1 << HASH_BITS)
            for label in (0, 1):
                sums[label] += np.bincount(code[toxic[text] == label], minlength=1 << HASH_BITS)
    code = np.flatnonzero(sums.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(code), pa.array(sums[0][code]), pa.array(sums[1][code])], ["code", "clean", "toxic"])


def _slots(terms: list[int]) -> np.ndarray:
    slots = np.full(1 << HASH_BITS, -1, np.int64)
    slots[terms] = np.arange(len(terms))
    return slots


def _known_terms(slots: np.ndarray, data, offsets):
    text, code = term_codes(data, offsets)
    slot = slots[code]
    known = slot >= 0
    return _counted(text[known], slot[known], max(1, slots.max() + 1))


def _value(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + np.minimum(counts, MAX_COUNT)).astype(np.float32) / 2


def _sample_rows(slots: np.ndarray):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                text, slot, counts = _known_terms(slots, data, offsets)
                bounds = np.searchsorted(text, np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.minimum(counts, MAX_COUNT).astype(np.int32)))],
                    ["id", "toxic", "slots", "counts"])

    return run


def pair_sums(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(machine's sums before the logistic, x @ v) of the rows of ``x``."""
    s = x @ v
    return w0 + x @ w + 0.5 * ((s**2).sum(axis=1) - (x**2) @ (v**2).sum(axis=1)), s


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(
    counts: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7,
    rate: float = 0.08, l2: float = 2e-4, rows: int = 128,
) -> tuple[float, np.ndarray, np.ndarray]:
    """(w0, w, v) by AdaGrad on the logistic loss; ``counts``: rows x terms."""
    draw = np.random.default_rng(seed)
    n, terms = counts.shape
    share = (y.sum() + 0.5) / (n + 1)
    w0, w = float(np.log(share / (1 - share))), np.zeros(terms, np.float32)
    v = draw.normal(0, 0.02, (terms, factors)).astype(np.float32)
    if not n or not terms:
        return w0, w, v
    g0, gw, gv = 1e-6, np.full(terms, 1e-3, np.float32), np.full(v.shape, 1e-3, np.float32)
    for _ in range(epochs):
        order = draw.permutation(n)
        for at in range(0, n, rows):
            part = order[at : at + rows]
            x = _value(counts[part])
            z, s = pair_sums(x, w0, w, v)
            error = ((logistic(z) - y[part]) / len(part)).astype(np.float32)
            d0, dw = float(error.sum()), error @ x + l2 * w
            dv = x.T @ (error[:, None] * s) - v * (error @ (x**2))[:, None] + l2 * v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            w0 -= rate * d0 / g0**0.5
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return w0, w, v


def _fit_task(terms: int):
    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r["id"])
        counts = np.zeros((len(rows), terms), np.uint8)
        for i, r in enumerate(rows):
            counts[i, r["slots"]] = r["counts"]
        model = fit_machine(counts, np.array([r["toxic"] for r in rows], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, terms: int = TERMS,
) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(slots of hashed terms, w0, w, v) from at most ``sample_rows`` labelled rows.

    Rows of a null id or label are not used; a repeated label counts once, as toxic if one
    of them says so. Without any labelled row the model is a constant."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).cast("bigint").alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("toxic"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most `sample_rows` rows of 12 bytes are broadcast.
    sample = materialize(rows.join(F.broadcast(drawn), "id").select("id", "text", "toxic"), "toxic-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = (float(totals.get(k, 0)) for k in (0, 1))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi = F.pow(a * d - b * c, F.lit(2.0)) / ((a + b) * (c + d) + 1) / (n0 * n1 + 1)
    chosen = (
        arrow_map(sample, _term_texts, "code bigint, clean bigint, toxic bigint")
        .groupBy("code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
        .orderBy(chi.desc(), "code").limit(terms).select("code").collect()
    )
    slots = _slots([r["code"] for r in chosen])
    one_task = arrow_map(sample, _sample_rows(slots), "id bigint, toxic int, slots array<int>, counts array<int>").coalesce(1)
    models = arrow_map(one_task, _fit_task(max(1, len(chosen))), "model binary").collect()
    return slots, *pickle.loads(bytes(models[0]["model"]))


def _scored(model, batch: pa.RecordBatch, at: int):
    """(rows, their scores) of a batch whose column ``at`` is the text."""
    slots, w0, w, v = model
    norm = (v**2).sum(axis=1)
    for rows, data, offsets in text_slices(batch, at):
        n = len(rows)
        text, slot, counts = _known_terms(slots, data, offsets)
        x = _value(counts).astype(np.float64)
        z = np.bincount(text, x * w[slot] - 0.5 * x**2 * norm[slot], n) + w0
        for f in range(v.shape[1]):
            z += 0.5 * np.bincount(text, x * v[slot, f], n) ** 2
        yield rows, logistic(z)


def _scores(model):
    def run(batches):
        for batch in batches:
            for rows, found in _scored(model, batch, 1):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], ["id", "score"])

    return run


def _kept(model, at: int, limit: float):
    def run(batches):
        for batch in batches:
            for rows, found in _scored(model, batch, at):
                yield rows.filter(pa.array(found < limit))

    return run


def held_out(id_col: Column) -> Column:
    """Whether a row's label is kept from fitting: crc32 of its id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; score is from 0 to 1, higher for toxic texts.

    Null and empty texts get the score of a text without terms. Rows of a null id and
    repeated rows are scored like any other. Other columns are not read, whatever their
    names."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, _scores(model), "id bigint, score double")


def keep_clean(docs: DataFrame, model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``limit``, all columns as they are; no shuffle.
    A null text is judged as an empty one."""
    return arrow_map(docs, _kept(model, docs.columns.index(text_col), limit), docs.schema)


def fit_held(docs: DataFrame, labels: DataFrame):
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def op4_toxicity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_held(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
