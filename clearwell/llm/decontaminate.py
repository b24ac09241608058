"""Finding passages of a benchmark in documents by winnowing.

A text's fingerprints are the smallest of each ``WINDOW`` = 6 consecutive hashes of
``GRAM`` = 5 words, so any span of 10 words that two texts share holds a fingerprint of
both. Documents and items are joined on fingerprints; each hit is then extended word by
word to both sides, and spans of ``SPAN`` = 10 or more equal words count. An item of
fewer than 10 words counts as a whole: its length's grams are looked up at every place.

Before the join, fingerprints of documents pass a bitmap of the items' fingerprints of
fixed size (1 MB): it drops most that meet nothing and never one that does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import materialize
from .common import (
    UINT, arrow_map, gram_hashes, mix, small_or_plain, split_words, text_slices, word_hashes, word_spans,
)

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
FILTER_BITS = 1 << 23


def _places(last: np.ndarray, k: int) -> np.ndarray:
    """Whether k words from each position on lie in one text; ``last``: the text's end."""
    return np.arange(len(last)) + k <= last


def winnow(words: np.ndarray, first: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the fingerprints of texts whose words lie one behind the other:
    all places that hold the minimum of some window."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, UINT)
    last = np.repeat(first[1:], np.diff(first))
    grams = gram_hashes(words, gram)
    whole = _places(last, gram + window - 1)
    lowest = grams.copy()
    for j in range(1, window):
        np.minimum(lowest, np.roll(grams, -j), out=lowest)
    chosen = np.zeros(n, bool)
    for j in range(window):
        hit = whole & (np.roll(grams, -j) == lowest)
        chosen |= np.roll(hit, j)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _family(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of whole items of k words, apart from those of winnowed grams."""
    return mix(hashes + UINT(1000 + k))


def _items(batches):
    """Fingerprints of benchmark items with the words around: all that the windows of
    ``SPAN`` words around the gram can hold."""
    for batch in batches:
        out = [[] for _ in range(5)]
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split_words(text)
            if not words:
                continue
            line = np.frombuffer(b" ".join(words), np.uint8)
            low, starts, ends, first = word_spans(line, np.array([0, len(line)]))
            hashes = word_hashes(low, starts, ends)
            if len(words) < SPAN:
                found = [(0, len(words), _family(gram_hashes(hashes, len(words))[:1], len(words))[0])]
            else:
                found = [(int(p), GRAM, h) for p, h in zip(*winnow(hashes, first))]
            for p, k, h in found:
                low_end = max(0, p + k - SPAN)
                around = words[low_end : p + SPAN] if len(words) >= SPAN else words
                for column, value in zip(out, (item, int(h.view(np.int64)), k, p - low_end, b" ".join(around).decode())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
            ["item", "hash", "k", "at", "around"])


def _marks(short: list[int], bitmap: np.ndarray):
    """Fingerprints of documents that pass the bitmap."""

    def passed(h):
        bit = h & UINT(FILTER_BITS - 1)
        return (bitmap[bit >> UINT(3)] >> (bit & UINT(7)).astype(np.uint8)) & 1 == 1

    def run(batches):
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                low, starts, ends, first = word_spans(data, offsets)
                words = word_hashes(low, starts, ends)
                at, hashes = winnow(words, first)
                keep = passed(hashes)
                found = [(at[keep], hashes[keep], GRAM)]
                last = np.repeat(first[1:], np.diff(first))
                for k in short:
                    grams = _family(gram_hashes(words, k), k)
                    spot = np.flatnonzero(_places(last, k) & passed(grams))
                    found.append((spot, grams[spot], k))
                where = np.concatenate([x[0] for x in found])
                marks = np.concatenate([x[1] for x in found])
                sizes = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in found])
                text = np.searchsorted(first, where, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(text)), rows.column(2).take(pa.array(text)), pa.array(marks.view(np.int64)),
                     pa.array(sizes), pa.array(where - first[text])], ["id", "text_mark", "hash", "k", "place"])

    return run


def _extended(texts: pa.Array, hits: pa.Array) -> tuple[np.ndarray, list[list[str]]]:
    """(words inside occurrences, items with occurrences) of each text: its hits, verified
    against its words and extended to both sides."""
    hit_words, item_lists = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
    for i in np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False)):
        words = split_words(texts[int(i)].as_py())
        covered, items, seen = np.zeros(len(words), bool), set(), set()
        for hit in hits[int(i)].as_py():
            around, k, at, place = hit["around"].encode().split(), hit["k"], hit["at"], hit["place"]
            left, right = at, at + k
            shift = place - at
            if place + k > len(words) or words[place : place + k] != around[left:right]:
                continue
            if (hit["item"], shift, hit["around"]) in seen:
                continue
            seen.add((hit["item"], shift, hit["around"]))
            while left > 0 and shift + left > 0 and words[shift + left - 1] == around[left - 1]:
                left -= 1
            while right < len(around) and shift + right < len(words) and words[shift + right] == around[right]:
                right += 1
            if right - left >= min(SPAN, len(around)):
                covered[shift + left : shift + right] = True
                items.add(hit["item"])
        hit_words[i], item_lists[i] = covered.sum(), sorted(x for x in items if x is not None)
    return hit_words, item_lists


def _extend(batches):
    for batch in batches:
        for rows, data, offsets in text_slices(batch, 1):
            counts = np.diff(word_spans(data, offsets)[3])
            hit_words, items = _extended(rows.column(1), rows.column(2))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts.astype(np.int64)), pa.array(hit_words),
                 pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "n_hit", "items"])


def _clean(at: int):
    """Rows without a hit; the hits are the last column, which goes."""

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            hit_words, _ = _extended(batch.column(at), batch.column(last))
            yield batch.select(range(last)).filter(pa.array(hit_words == 0))

    return run


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, text_mark, hits) of the documents that share a fingerprint with an item. ``docs``:
    (id, text), ``items``: (item, text). hits: place, k, at, around, item of each. A document
    goes by its id and the hash of its text, so rows without ids are no common group."""
    marks = materialize(
        arrow_map(items, _items, "item string, hash bigint, k int, at int, around string"), "item-fingerprints")
    # At most 256 maps of 4 KB and nine lengths reach the driver, whatever the benchmark.
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    maps = marks.groupBy(F.shiftright(bit, 15).alias("part")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps:
        bitmap[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    short = sorted(r["n"] for r in marks.where("at = 0").select(
        F.size(F.split("around", " ")).alias("n")).where(F.col("n") < SPAN).distinct().collect())
    spots = arrow_map(
        docs.select("id", "text", F.xxhash64("text").alias("text_mark")), _marks(short, bitmap),
        "id bigint, text_mark bigint, hash bigint, k int, place bigint")
    size = F.lit(40) + F.octet_length("around") + F.coalesce(F.octet_length("item"), F.lit(0))
    met = spots.join(small_or_plain(marks, size), ["hash", "k"])
    # Sets: repeated rows and items add nothing, so a group is bounded by its text.
    return met.groupBy("id", "text_mark").agg(
        F.collect_set(F.struct("place", "k", "at", "around", "item")).alias("hits"))


def _with_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``docs`` with a last column of their hits, null for none."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    found = materialize(candidates(rows, items), "hits")
    # Per hit: the words around and some fixed fields; lists are bounded by a document's length.
    size = F.aggregate("hits", F.lit(0), lambda t, x: t + F.octet_length(x["around"]) + 60)
    side = small_or_plain(found, size).select(
        F.col("id").alias("__hit_id"), F.col("text_mark").alias("__hit_mark"), F.col("hits").alias("__hits"))
    own = F.col(id_col).cast("bigint").eqNullSafe(F.col("__hit_id"))
    same = F.xxhash64(F.col(text_col).cast("string")) == F.col("__hit_mark")
    return docs.join(side, own & same, "left").drop("__hit_id", "__hit_mark")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, items) per document row: its words, those inside an
    occurrence of a window of an item, and the items with such occurrences as sorted text.

    Null and empty texts have no words. Rows of a null id keep their row. Repeated
    documents are answered one by one; repeated items count once by their id, and items of
    a null id make words hit but are not listed. Empty tables give empty or clean results.
    Other columns are not read, whatever their names."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = _with_hits(rows, benchmark, "id", "text", item_col, item_text_col)
    return arrow_map(joined, _extend, "id bigint, n_words bigint, n_hit bigint, items array<string>")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all columns as they are."""
    joined = _with_hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return arrow_map(joined, _clean(docs.columns.index(text_col)), docs.schema)


def op2_decontaminate(spark, folder):
    rows = contamination(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP2_SQL = f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce("text", ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce("text", ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w
  from benchmark),
windows as (
  select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') g
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) p
        from (select item_id, w, least(10, len(w)) k from b where len(w) > 0))),
grams as (
  select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) p
        from d, (select distinct k from windows) where len(w) >= k)),
met as (select doc_id, k, p, item_id from grams join windows using (k, g)),
hit as (
  select doc_id, count(*) n_hit
  from (select distinct doc_id, unnest(range(p, p + k)) q from (select distinct doc_id, p, k from met)) group by doc_id),
listed as (
  select doc_id, count(*) n_items, string_agg(i, ',' order by i) items
  from (select distinct doc_id, cast(item_id as varchar) i from met) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
  cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from d left join hit on d.doc_id = hit.doc_id left join listed on d.doc_id = listed.doc_id
"""
