"""CSV records put together in parallel, whatever line breaks their quotes hold.

Lines are read in splits. A line takes the state "outside" or "inside quotes" to another such
state; the lines of a block (one split of one file) together are one such step, and the steps of a
file's blocks, one after the other, say in which state each block begins. With that every task
puts the records of its block together by itself; only the fragments of records that cross a
border of blocks are brought together. Cells and headers are counted in the same scan.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.packaging import ship
from ..functions.storage import materialize

# States of the walk over a line: outside where a quote is a letter, outside where it opens a cell,
# inside, and behind a quote inside (the end of the cell, or the first of two that mean one).
_LETTER, _OPENS, _INSIDE, _QUOTE = range(4)


def _walk(line: Column, quote: str, sep: str, inside: bool) -> Column:
    """(state, cells): the state behind ``line`` and the delimiters outside quotes."""
    pieces = F.split(line, _literal(quote))
    sep_size = F.lit(len(sep))

    def behind(piece: Column, empty: Column) -> Column:
        return F.when(piece == "", empty).when(F.endswith(piece, F.lit(sep)), F.lit(_OPENS)).otherwise(F.lit(_LETTER))

    def marks(piece: Column) -> Column:
        return ((F.length(piece) - F.length(F.replace(piece, F.lit(sep), F.lit("")))) / sep_size).cast("int")

    first = F.get(pieces, F.lit(0))
    start = F.struct(
        (F.lit(_INSIDE) if inside else behind(first, F.lit(_OPENS))).alias("state"),
        (F.lit(0) if inside else marks(first)).alias("cells"))

    def step(now: Column, piece: Column) -> Column:
        met = F.when(now["state"] == _OPENS, _INSIDE).when(now["state"] == _INSIDE, _QUOTE).when(
            now["state"] == _QUOTE, _INSIDE).otherwise(_LETTER)
        outside = (met == _LETTER) | ((met == _QUOTE) & (piece != ""))
        state = F.when(met == _INSIDE, _INSIDE).otherwise(behind(piece, met))
        return F.struct(state.alias("state"), (now["cells"] + F.when(outside, marks(piece)).otherwise(0)).alias("cells"))

    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def steps(line: Column, quote: str, sep: str) -> list[Column]:
    """to0, to1 (is the state inside, if it was outside or inside before?) and cells, from outside."""
    plain = ~F.contains(line, F.lit(quote))
    walked = _walk(line, quote, sep, False)
    cells = ((F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))) / F.lit(len(sep))).cast("int")
    return [
        F.when(plain, False).otherwise(walked["state"] == _INSIDE).alias("to0"),
        F.when(plain, True).otherwise(_walk(line, quote, sep, True)["state"] == _INSIDE).alias("to1"),
        (F.when(plain, cells).otherwise(walked["cells"]) + 1).alias("cells"),
    ]


def cell_count(record: Column, quote: str, sep: str) -> Column:
    return _walk(record, quote, sep, False)["cells"] + 1


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line) in the order of the file within each block."""
    line = F.regexp_replace(F.col("value"), "\r$", "")
    first = F.col("_metadata.file_block_start") == 0
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.when(first, F.regexp_replace(line, "^\ufeff", "")).otherwise(line).alias("line"))


_BLOCKS = (
    "file string, block bigint, to0 boolean, to1 boolean, starts0 boolean, starts1 boolean, breaks boolean, header string, "
    "counts array<struct<cells:int,n:bigint>>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, to0, to1, cells, line or null) -> one line per block."""
    done: list[dict] = []
    now: dict | None = None

    def close(block: dict) -> dict:
        return block | {"counts": [{"cells": c, "n": n} for c, n in sorted(block["counts"].items())]}

    for batch in batches:
        if not batch.num_rows:
            continue
        at = _borders(batch)
        for a, b in zip(at[:-1], at[1:]):
            part = batch.slice(a, b - a)
            file, block = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            if now is None or (now["file"], now["block"]) != (file, block):
                if now is not None:
                    done.append(close(now))
                now = {"file": file, "block": block, "to0": False, "to1": True, "starts0": False, "starts1": False,
                       "breaks": False, "header": "" if block == 0 else None, "open": block == 0, "counts": {}}
            to0, to1 = (part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
            for key, start in (("0", now["to0"]), ("1", now["to1"])):
                before = _states(start, to0, to1)
                now["starts" + key] |= bool((~before[1:] if key == "1" else ~before).any())
                if key == "0":
                    now["breaks"] |= bool(to0.any())
                now["to" + key] = bool(np.where(before[-1], to1[-1], to0[-1]))
            row = 0
            while now["open"] and row < len(part):
                line = part.column(5)[row].as_py()
                now["header"] += line
                now["open"] = bool(to1[row] if now.get("within") else to0[row])
                now["within"] = now["open"]
                if now["open"]:
                    now["header"] += "\n"
                elif not line.strip() and not now["header"].strip():
                    now["header"], now["open"] = "", True  # blank lines are no header
                row += 1
            for cells, n in zip(*np.unique(part.column(4).to_numpy(zero_copy_only=False), return_counts=True)):
                now["counts"][int(cells)] = now["counts"].get(int(cells), 0) + int(n)
    if now is not None:
        done.append(close(now))
    names = ["file", "block", "to0", "to1", "starts0", "starts1", "breaks", "header", "counts"]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 5, pa.string(), pa.list_(pa.struct([("cells", pa.int32()), ("n", pa.int64())]))]
    yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(names, kinds)], names)


def _borders(batch: pa.RecordBatch) -> list[int]:
    """Where the rows of a batch go on to another block, and both ends."""
    block = batch.column(1).to_numpy(zero_copy_only=False)
    file = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    change = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
    return [0, *change.tolist(), batch.num_rows]


def _states(start: bool, to0: np.ndarray, to1: np.ndarray) -> np.ndarray:
    """Whether each line begins inside: the last line before it that ends in the same state from
    both, and the changes of state since."""
    n = len(to0)
    fixed, swaps = to0 == to1, to0 & ~to1
    turns = np.concatenate([[0], np.cumsum(swaps)])
    last = np.maximum.accumulate(np.where(fixed, np.arange(1, n + 1), 0))
    last = np.concatenate([[0], last])[:n]
    base = np.where(last > 0, to0[np.maximum(last - 1, 0)], start)
    return base ^ ((turns[:n] - turns[last]) % 2 == 1)


def scan(spark: SparkSession, path, quote: str, sep: str) -> DataFrame:
    """One line per block; its header is that of its file (null but in the first block), and
    ``counts`` has how many lines have how many cells."""
    read = lines(spark, path)
    head = F.when(F.col("block") == 0, F.col("line"))
    ship(spark)
    found = read.select("file", "block", *steps(F.col("line"), quote, sep), head.alias("line")).mapInArrow(_blocks, _BLOCKS)
    return materialize(found, "csv-blocks")


def starts(blocks: DataFrame) -> DataFrame:
    """(file, block, inside, owner): whether each block begins inside quotes, and the block in
    which the record that it begins in has begun."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("to0") & ~F.col("to1"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turned = blocks.withColumn("turns", turns)
    fixed = F.when(F.col("to0") == F.col("to1"), F.struct("to0", "turns"))
    last = F.last(fixed, ignorenulls=True).over(before)
    so_far = F.coalesce(F.lag("turns").over(order), F.lit(0))
    odd = (so_far - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    inside = turned.withColumn("inside", F.coalesce(last["to0"], F.lit(False)) != odd)
    begins = F.when(F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0")), F.col("block"))
    return inside.select("file", "block", "inside", F.last(begins, ignorenulls=True).over(before).alias("owner"))


_RECORDS = "file string, block bigint, place bigint, record string, whole boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, to0, to1, line, value, inside, owner) -> records, and the fragments of those that
    cross a border: ``block`` is then where the record begins and ``place`` where the fragment lies."""
    now, parts, key, owner, place = False, [], None, None, 0

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()])],
            ["file", "block", "place", "record", "whole"])

    for batch in batches:
        rows: list[tuple] = []
        if not batch.num_rows:
            continue
        at = _borders(batch)
        for a, b in zip(at[:-1], at[1:]):
            part = batch.slice(a, b - a)
            file, block = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            if key != (file, block):
                if parts:  # open at the end of its block
                    rows.append((key[0], owner, key[1], "\n".join(parts) + "\n", False))
                key, place, parts = (file, block), 0, []
                now = bool(part.column(6)[0].as_py())
                # The first record belongs to another block if this one begins inside.
                owner = part.column(7)[0].as_py() if now else block
            to0, to1 = (part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
            before = _states(now, to0, to1)
            after = np.where(before, to1, to0)
            now = bool(after[-1])
            if not before.any() and not after.any():
                for line in part.column(4).to_pylist():
                    rows.append((file, block, place, line, True))
                    place += 1
                continue
            texts, raw = part.column(4).to_pylist(), part.column(5).to_pylist()
            for i, (starts_inside, ends_inside) in enumerate(zip(before.tolist(), after.tolist())):
                if not starts_inside:
                    owner = block
                # Within quotes a carriage return before the line end is text.
                parts.append(raw[i] if ends_inside else texts[i])
                if ends_inside:
                    continue
                if owner == block:
                    rows.append((file, block, place, "\n".join(parts), True))
                    place += 1
                else:
                    rows.append((file, owner, block, "\n".join(parts), False))
                parts = []
        yield out(rows)
    if parts:
        yield out([(key[0], owner, key[1], "\n".join(parts) + "\n", False)])


def records(spark: SparkSession, path, blocks: DataFrame, quote: str, sep: str) -> DataFrame:
    """(file, record) of all files of ``path``, which ``blocks`` of ``scan`` describe, without their
    header records and blank lines."""
    # Blocks that begin inside: most have none, so the others need no partner.
    begun = materialize(starts(blocks).where("inside"), "csv-starts").select(
        F.col("file").alias("of"), F.col("block").alias("at"), "inside", "owner")
    read = lines(spark, path)
    # At most one short line per split, some millionth of the files; lines must keep their order.
    met = read.join(F.broadcast(begun), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")), "left")
    found = met.select(
        "file", "block", *steps(F.col("line"), quote, sep)[:2], "line", "value", F.coalesce("inside", F.lit(False)).alias("inside"), "owner")
    made = materialize(found.mapInArrow(_records, _RECORDS), "csv-records")
    crossing = made.where("not whole").groupBy("file", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda x: x["record"]), "").alias("record"),
        F.lit(None).cast("bigint").alias("place"))
    joined = made.where("whole").select("file", "block", "place", "record").unionByName(crossing)
    # The header is the first record with text of its file.
    text = joined.where(F.trim("record") != "")
    heads = text.where("block = 0").groupBy("file").agg(F.min(F.coalesce("place", F.lit(1 << 62))).alias("head"))
    named = heads.select(F.col("file").alias("of"), "head")
    return text.join(named, F.col("file") == F.col("of"), "left").where(
        (F.col("block") != 0) | F.col("head").isNull() | (F.coalesce("place", F.lit(1 << 62)) != F.col("head"))).select("file", "record")


def column_names(header: str, quote: str, sep: str) -> list[str]:
    """The cells of a header: an empty one is "Unnamed: i", and one that repeats gets the next free
    number behind a dot. Names that differ in case only count as repeated, as they do for Spark."""
    cells = next(csv.reader(io.StringIO(header, newline=""), delimiter=sep, quotechar=quote), [])
    cells = [c if c else f"Unnamed: {i}" for i, c in enumerate(cells)]
    taken, used, out = {c.lower() for c in cells}, set(), []
    for c in cells:
        new, number = c, 0
        while new.lower() in used or (number and new.lower() in taken):
            number += 1
            new = f"{c}.{number}"
        used.add(new.lower())
        out.append(new)
    return out
