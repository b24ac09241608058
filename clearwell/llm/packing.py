"""Packing token sequences by best fit over a histogram of lengths.

The plan is made for counts, not documents: lengths from long to short, all pieces of one
length at once, go to the open sequences with the least room that still holds them. Its
size depends on the sequence length only (some thousand lines), so the driver can hold it
whatever the number of documents. Pieces then take planned slots by their rank within
their length, in one join.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.storage import materialize
from .common import arrow_map

LENGTH = 2048
END_ID = 0
# Pieces of one length are ranked in so many groups, as one length may be very frequent.
RANK_GROUPS = 64
SLICE_CHARS = 1 << 21
# Words that a worker remembers before it starts anew (some 150 bytes each).
MOST_WORDS = 300_000

_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+")
_BEHIND = ".,;:!?*#%&$|()[]-\""
# What punctuation may be cut off from: nothing, or a word whose end is surely a letter or digit.
_SOUND = "^$|[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]$"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Grown:
    """A number array that grows at its end."""

    def __init__(self, kind):
        self.data, self.used = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(len(self.data), len(values)), self.data.dtype)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)


class Encoder:
    """Token ids of many texts. This vocabulary drops white space and merges within words
    only, so each distinct word is encoded once and its ids are laid out for every place.
    Words are told apart from the punctuation behind them, as the tokenizer's own splitting
    does. Lower-case Latin words go to the merge model directly, all others through the
    tokenizer. Texts with the marker of a special token, or with other signs between a word
    and its punctuation, are encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.sizes, self.flat = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)

    def _through(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _ids(self, word: str) -> list[int]:
        if not word.isascii():
            if not _LATIN.fullmatch(word):
                return self._through(word)
            low = word.lower()
            if len(low) != len(word) or not low.isalpha():
                return self._through(word)
            word = low.encode().decode("latin-1").translate(_BYTE_LETTERS)
        elif not word.isalpha() or not word.islower():
            return self._through(word)
        return [t.id for t in self.merges.tokenize(word)]

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word; new ones are encoded."""
        coded = pc.dictionary_encode(words)
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if new:
            ids = [self._ids(w) for w in new]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.number.update(zip(new, range(self.sizes.used, self.sizes.used + len(new))))
            self.starts.extend(self.flat.used + np.cumsum(sizes) - sizes)
            self.sizes.extend(sizes)
            self.flat.extend(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
        return number[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        cores = pc.ascii_lower(pc.utf8_rtrim(words, characters=_BEHIND))
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        cut = pc.not_equal(pc.binary_length(words), pc.binary_length(cores)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cut)
        held, behind = words.take(pa.array(at)), cores.take(pa.array(at))
        tails = pa.array([w[len(c) :] for w, c in zip(held.to_pylist(), behind.to_pylist())], pa.string())
        odd = ~pc.match_substring_regex(behind, _SOUND).to_numpy(zero_copy_only=False)
        whole[np.searchsorted(bounds, at[odd], "right") - 1] = True
        # Two places for each word: the word and what is behind it.
        number = np.full((len(words), 2), -1, np.int64)
        if len(self.number) > MOST_WORDS:
            self._clear()
        number[at, 1] = self._numbers(tails)
        number[:, 0] = self._numbers(cores)
        number = number.reshape(-1)
        counts = np.where(number < 0, 0, self.sizes.data[number])
        ends = np.cumsum(counts)
        place = np.arange(ends[-1] if len(ends) else 0)
        tokens = self.flat.data[np.repeat(self.starts.data[number] - (ends - counts), counts) + place]
        borders = np.concatenate([[0], ends])[bounds * 2]
        out = [tokens[a:b] for a, b in zip(borders[:-1], borders[1:])]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self._through(texts[int(i)].as_py()), np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: words stay known from task to task."""
    return Encoder(path)


def _pieces(path: str, length: int, end_id: int):
    def run(batches):
        known = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                base = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + SLICE_CHARS, "right")))
                rows, numbers, starts, lengths, marks = [], [], [], [], []
                for i, tokens in enumerate(known.encode(texts.slice(at, end - at)), at):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for number, start in enumerate(range(0, len(tokens), length)):
                        piece = tokens[start : start + length]
                        rows.append(i)
                        numbers.append(number)
                        starts.append(start)
                        lengths.append(len(piece))
                        marks.append(zlib.crc32(piece.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(marks, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])
                at = end

    return run


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    tokenizer: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of every text, closed by ``end_id``
    and cut after each ``length`` ids. A null text counts as empty: one piece of one id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(
        rows, _pieces(tokenizer or tokenizer_path(), length, end_id),
        "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, long pieces first, over ``counts`` (length -> pieces). Lines are (length,
    first rank, end rank, first sequence, pieces of this length per sequence, offset)."""
    lines: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, how many)
    rooms: list[int] = []
    opened = 0

    def leave(room: int, first: int, many: int) -> None:
        if room:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, many))

    for size in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[size]
        while left:
            place = bisect_left(rooms, size)
            if place < len(rooms):
                room = rooms[place]
                first, many = runs[room].pop()
                if not runs[room]:
                    rooms.pop(place)
            else:
                room, first = length, opened
                many = -(-left // (length // size))
                opened += many
            each = room // size
            full = min(many, left // each)
            if full:
                lines.append((size, rank, rank + full * each, first, each, length - room))
                leave(room - each * size, first, full)
                rank += full * each
                left -= full * each
            if full < many:
                if left:  # fewer than one sequence takes
                    lines.append((size, rank, rank + left, first + full, left, length - room))
                    leave(room - left * size, first + full, 1)
                    leave(room, first + full + 1, many - full - 1) if many - full > 1 else None
                    left = 0
                else:
                    leave(room, first + full, many - full)
    return lines


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    tokenizer: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every
    row. Sequences hold at most ``length`` ids without gaps.

    Null and empty texts are a piece of the closing id alone. Rows of a null id and
    repeated rows are packed like any others. An empty table gives no piece. Other columns
    are not read, whatever their names."""
    spark = docs.sparkSession
    cut = materialize(
        pieces(docs, id_col, text_col, length, tokenizer, end_id).withColumn(
            "group", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(RANK_GROUPS)).cast("int")),
        "pieces")
    # Ranks within a length: within its groups, after the sizes of the groups before.
    # At most `length` x RANK_GROUPS sizes, of which the driver gets `length` sums.
    sizes = cut.groupBy("length", "group").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("group")) - F.col("count")
    sizes = materialize(sizes.select("length", "group", "count", before.alias("before")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, length),
        "slot_length bigint, first_rank bigint, end_rank bigint, first_sequence bigint, each bigint, at bigint")
    within = F.row_number().over(Window.partitionBy("length", "group").orderBy("id", "piece", "ids_crc32")) - 1
    # Bounded by length x RANK_GROUPS rows of 28 bytes; the plan by some lines per length.
    ranked = cut.withColumn("rank", within).join(
        F.broadcast(sizes.select(F.col("length").alias("l"), F.col("group").alias("g"), "before")),
        (F.col("length") == F.col("l")) & (F.col("group") == F.col("g"))).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    place = F.col("rank") - F.col("first_rank")
    return placed.select(
        "id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(place / F.col("each")).cast("bigint")).alias("sequence_id"),
        (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"))


def op3_best_fit_packing(spark, folder):
    return pack(spark.read.parquet(f"{folder}/documents.parquet")).withColumnRenamed("id", "doc_id")
