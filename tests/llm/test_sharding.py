import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from clearwell.functions.storage import fresh_path
from clearwell.llm import sharding
from clearwell.llm.sharding import SlotMap, edited, place

from .cases import AWKWARD, documents


def placed(spark, df, shards=24, slots=4096):
    return place(df, SlotMap.create(spark, fresh_path(spark, "slot-map"), shards, slots), shards=shards)


def check(rows, got, shards):
    """Every row once, its size and checksum, places gapless; returns the bytes of each shard."""
    want = sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r["id"]), r["size"], r.text_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in h) == list(range(len(h))) for h in held.values())
    assert all(0 <= s < shards for s in held)
    return [sum(r["size"] for r in held.get(s, [])) for s in range(shards)]


def test_awkward_rows(spark):
    check(AWKWARD, placed(spark, documents(spark, AWKWARD)).collect(), 24)
    assert placed(spark, documents(spark, [])).count() == 0


def test_bytes_are_near_equal(spark):
    draw = random.Random(1)
    rows = [(i, "x" * int(draw.paretovariate(1.2) * 100)) for i in range(4000)]
    loads = check(rows, placed(spark, documents(spark, rows)).collect(), 24)
    assert max(loads) - min(loads) <= 0.01 * np.mean(loads) or max(loads) <= max(len(t) + 8 for _, t in rows)


def test_a_very_frequent_record_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 3)
    monkeypatch.setattr(sharding, "COPIES", 16)
    rows = [(5, "hot text")] * 3000 + [(None, None)] * 500 + [(i, f"text {i}") for i in range(2000)]
    loads = check(rows, placed(spark, documents(spark, rows), 6, 300).collect(), 6)
    assert max(loads) < 1.05 * min(loads)


def test_versions_move_few_records(spark):
    rows = [(i, "word " * (i % 40)) for i in range(3000)]
    docs = documents(spark, rows)
    slot_map = SlotMap.create(spark, fresh_path(spark, "slot-map"), 4, 256)
    first = {r["id"]: (r.virtual_slot, r.shard) for r in place(docs, slot_map, shards=4).collect()}
    again = {r["id"]: (r.virtual_slot, r.shard) for r in place(docs, slot_map, shards=4).collect()}
    assert again == first  # nothing left to move
    more = {r["id"]: (r.virtual_slot, r.shard) for r in place(docs, slot_map, shards=5).collect()}
    assert all(more[i][0] == first[i][0] for i in first)
    moved = [i for i in first if more[i][1] != first[i][1]]
    assert 0.1 * len(first) < len(moved) < 0.3 * len(first)
    less = {r["id"]: r.shard for r in place(docs, slot_map, shards=3).collect()}
    assert set(less.values()) == {0, 1, 2}
    assert sum(less[i] != more[i][1] for i in first if more[i][1] < 3) < 0.15 * len(first)
    assert [r.version for r in slot_map.table().select("version").distinct().orderBy("version").collect()] == [0, 1, 2, 3, 4]
    assert slot_map.version(0).where(F.col("shard") != F.col("slot") % 4).isEmpty()


def test_edits(spark):
    draw = np.random.default_rng(3)
    for slots, shards in ((1, 3), (50, 7), (4096, 24)):
        weight = (draw.pareto(1.1, slots) * 1000).astype(np.int64)
        now = np.arange(slots) % shards
        new = edited(now, weight, shards)
        load = np.bincount(new, weight, shards)
        assert set(new) <= set(range(shards)) and load.max() <= max(1.01 * weight.sum() / shards, weight.max()) + (slots < 100) * weight.max()
        assert (edited(now, np.zeros(slots, np.int64), shards) == now).all()
