"""Shards of near equal bytes over a fixed number of virtual slots.

A record is hashed into one of ``SLOTS`` virtual slots, whose number never changes. Which
shard holds a slot is said by a map, a table of (version, slot, shard) of ``SLOTS`` rows per
version. Bytes are aggregated per slot; a rebalancing edits the map, that is, it moves some
slots from shards with too many bytes to shards with too few and stores the outcome as the
next version. Records are never hashed anew, so only those of moved slots change shard.

What reaches the driver is one line per slot, whatever the number of records. Places within
a shard come from counts: records are numbered within small groups of their slot, and each
group starts where those before it in its shard end, so no task holds a shard or a slot.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.storage import fresh_path, materialize

SLOTS = 4096
SHARDS = 24
# Sums of shards that differ by no more than this share of the mean are left as they are.
NEAR = 0.001
# Bytes of a record besides its text.
OVERHEAD = 8
# Records that are numbered together, at most some.
GROUP_ROWS = 100_000
# Copies of one record that one row stands for, at most.
COPIES = 4096
MAP_SCHEMA = "version int, slot int, shard int"


# -- the map ----------------------------------------------------------------- #


class SlotMap:
    """Versions of the slot-to-shard map under one folder, each written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 0: slots dealt to shards in turn."""
        made = cls(spark, path)
        made._append(0, np.arange(slots) % shards)
        return made

    def _append(self, version: int, shard_of: np.ndarray) -> None:
        rows = [(version, slot, int(shard)) for slot, shard in enumerate(shard_of)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self.path)

    def latest(self) -> int:
        return self.table().agg(F.max("version")).first()[0]

    def version(self, number: int | None = None) -> DataFrame:
        """(slot, shard) of one version, by default the last."""
        number = self.latest() if number is None else number
        return self.table().where(F.col("version") == number).select("slot", "shard")

    def rebalance(self, loads: DataFrame, shards: int | None = None) -> int:
        """Stores the next version for ``loads`` (slot, bytes) and ``shards`` shards (by default
        as many as now) and returns its number."""
        number = self.latest()
        now = np.array([r.shard for r in sorted(self.version(number).collect())], np.int64)
        weight = np.zeros(len(now), object)
        for r in loads.select("slot", "bytes").collect():  # one line per slot
            weight[r.slot] = int(r.bytes)
        self._append(number + 1, edited(now, weight.astype(np.int64), shards or int(now.max()) + 1))
        return number + 1


def edited(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """``shard_of`` (slot -> shard) with some slots moved so that the ``shards`` sums of
    ``weight`` become near equal.

    Shards above the mean give up the slots that bring them nearest to it from above, shards
    that are no more give up all; these slots go, heavy ones first, to the lightest shard.
    Then shards exchange slots as long as that lowers the larger sum of the two."""
    place = shard_of.copy()
    total = int(weight.sum())
    held = [np.flatnonzero((place == s) & (weight > 0)) for s in range(shards)]
    free = list(np.flatnonzero((place >= shards) & (weight > 0)))
    empty = np.flatnonzero((place >= shards) & (weight == 0))
    place[empty] = np.arange(len(empty)) % shards
    load = np.zeros(shards, np.int64)
    for s in range(shards):
        load[s] = weight[held[s]].sum()
        if load[s] * shards <= total * (1 + NEAR):
            continue
        for slot in held[s][np.argsort(-weight[held[s]], kind="stable")]:
            if (load[s] - weight[slot]) * shards >= total:
                load[s] -= weight[slot]
                free.append(slot)
    heap = [(int(load[s]), s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda x: (-weight[x], x)):
        least, s = heapq.heappop(heap)
        place[slot] = s
        heapq.heappush(heap, (least + int(weight[slot]), s))
    _level(place, weight, shards)
    return place


def _level(place: np.ndarray, weight: np.ndarray, shards: int) -> None:
    """Moves of one slot, or exchanges of two, between shards whose sums differ by more than
    ``NEAR`` of the mean, from the heaviest down, until none lowers the larger sum of the two."""
    load = np.bincount(place, weight, shards).astype(np.int64)
    near = max(1, int(NEAR * weight.sum() / shards))

    def lowered(top: int, other: int) -> bool:
        gap = load[top] - load[other]
        mine, theirs = (np.flatnonzero((place == s) & (weight > 0)) for s in (top, other))
        gives = np.append(weight[theirs], 0)
        order = np.argsort(gives, kind="stable")
        # For each slot of the heavier: the two slots (or none) whose difference is nearest to half of the gap.
        at = np.searchsorted(gives[order], weight[mine] - gap // 2).clip(0, len(gives) - 1)
        two = order[np.stack([np.maximum(at - 1, 0), at])]
        change = weight[mine] - gives[two]
        off = np.where((change > 0) & (change < gap), np.abs(2 * change - gap), np.iinfo(np.int64).max)
        best = np.unravel_index(off.argmin(), off.shape)
        if off[best] == np.iinfo(np.int64).max:
            return False
        place[mine[best[1]]] = other
        if two[best] < len(theirs):
            place[theirs[two[best]]] = top
        load[top] -= change[best]
        load[other] += change[best]
        return True

    for _ in range(8 * len(place)):
        order = np.argsort(load, kind="stable")
        pairs = ((top, other) for top in order[::-1] for other in order if load[top] - load[other] > near)
        if not any(lowered(int(top), int(other)) for top, other in pairs):
            return


# -- records ----------------------------------------------------------------- #


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, slot, spread, copies): distinct records, each with its slot and
    the number of rows it stands for, at most ``COPIES``.

    A record is an id and a text. Copies of a record count as records of their own: beyond the
    first they are hashed with their number, so even a record that is very frequent is spread
    over all slots. They are combined before they are shuffled. ``spread`` is a further hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.col(id_col).cast("bigint"), text).alias("mark"))
    same = rows.groupBy("id", "size", "text_crc32", "mark").agg(F.count(F.lit(1)).alias("rows"))

    def placed(df: DataFrame, copies: Column, *number: Column) -> DataFrame:
        mark = F.xxhash64("mark", *number) if number else F.col("mark")
        spread = F.xxhash64(mark, F.lit(1))
        return df.select(
            "id", "size", "text_crc32", F.pmod(mark, F.lit(slots)).cast("int").alias("slot"), spread.alias("spread"), copies.alias("copies"))

    first = placed(same, F.lit(1).cast("bigint"))
    # Packs of further copies: few while a record is rare, many small ones for a hot record.
    pack = F.least(F.lit(COPIES), F.ceil(F.col("rows") / F.lit(COPIES)))
    packs = same.where("rows > 1").withColumn("pack", pack.cast("bigint")).withColumn(
        "packs", F.expr("(rows - 2) div pack + 1")).withColumn("number", F.explode(F.expr("sequence(1L, packs)")))
    further = placed(packs, F.expr("if(number = packs, rows - 1 - (packs - 1) * pack, pack)"), F.col("number"))
    return first.unionByName(further)


def slot_loads(placed: DataFrame) -> DataFrame:
    """(slot, rows, bytes) of the records of ``records``."""
    return placed.groupBy("slot").agg(F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("bytes"))


def shard(placed: DataFrame, slot_map: DataFrame, rows: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, shard, slot): one line per row that ``placed``, a
    written table of ``records``, stands for. ``slot`` counts the rows of a shard, gapless from
    0; ``rows`` is the number of all. ``slot_map`` is one version of the map."""
    slots = slot_map.count()
    groups = -(-rows // (max(1, slots) * group_rows)) or 1
    grouped = placed.withColumn("group", F.pmod("spread", F.lit(groups)).cast("int"))
    sizes = grouped.groupBy("slot", "group").agg(F.sum("copies").alias("n")).join(F.broadcast(slot_map), "slot")
    # One line per group: a shard's hold (slots x groups / shards) of them.
    before = Window.partitionBy("shard").orderBy("slot", "group")
    starts = sizes.select("slot", "group", "shard", (F.sum("n").over(before) - F.col("n")).alias("start"))
    within = Window.partitionBy("slot", "group").orderBy("id", "text_crc32", "size", "spread")
    numbered = grouped.withColumn("end", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    met = numbered.join(starts, ["slot", "group"])
    return met.select(
        "id", "size", "text_crc32", F.col("slot").alias("virtual_slot"), "shard",
        F.explode(F.expr("sequence(start + end - copies, start + end - 1)")).alias("slot"))


def place(
    docs: DataFrame, slot_map: SlotMap, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
) -> DataFrame:
    """One line of ``shard`` for every row of ``docs``, after a rebalancing of ``slot_map``
    for their bytes over ``shards`` shards.

    A null text counts as empty. Rows of a null id are records of that text. Repeated rows are
    spread and counted each. An empty table gives no row (and a version like the one before).
    Other columns are not read, whatever their names."""
    placed = materialize(records(docs, id_col, text_col, slot_map.version().count()), "records")
    loads = materialize(slot_loads(placed), "loads")
    rows = loads.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    version = slot_map.rebalance(loads, shards)
    return shard(placed, slot_map.version(version), rows)


def op11_sharding(spark, folder):
    slot_map = SlotMap.create(spark, fresh_path(spark, "slot-map"))
    rows = place(spark.read.parquet(f"{folder}/documents.parquet"), slot_map)
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
