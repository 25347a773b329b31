"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's key is hashed into one of a fixed number of slots, which never changes.  Only the small slot map
(one row per slot) knows shards: it starts with the slots dealt round, is stored with a version, and is edited
by the bytes measured per slot and when shards are added, so that only the rows of moved slots move.

A slot that is heavy by itself (one row repeated very often) is split into parts, each with its own place in the
map: a part's unit is slot + SLOTS * part, and the records of a split slot are dealt over its parts.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SLOTS = 4096
RECORD_BYTES = 8  # counted for each record beside its text
GRAIN = 64  # a slot that holds more than one such part of a shard's mean is split
TOLERANCE = 0.001
MAP = "version int, unit long, shard int"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (NULL: none) plus the record's own 8 bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def slot_of(key: Column, slots: int) -> Column:
    """Virtual slot of a key; NULL keys share one slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot; ``records`` has virtual_slot and size.  Pre-aggregated before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


class SlotMap:
    """One version of the map: ``shard_of[unit]``.  At most ``slots`` units and GRAIN parts of hot slots a shard, so it fits anywhere."""

    def __init__(self, shard_of: dict[int, int], shards: int, version: int = 1):
        self.shard_of, self.shards, self.version = shard_of, shards, version

    @classmethod
    def dealt(cls, slots: int, shards: int) -> SlotMap:
        """The first version, before any load is known: slots dealt round."""
        return cls({s: s % shards for s in range(slots)}, shards)

    def split(self, loads: dict[int, int]) -> SlotMap:
        """The next version, with the units that the measured loads need beyond the slots themselves, dealt round."""
        more = {u: (u % SLOTS + u // SLOTS) % self.shards for u in loads if u not in self.shard_of}
        return SlotMap(self.shard_of | more, self.shards, self.version + 1) if more else self

    def totals(self, loads: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, load in loads.items():
            out[self.shard_of[slot]] += load
        return out

    def grown(self, loads: dict[int, int]) -> SlotMap:
        """The next version with one more shard; slots move only into it, from the shards that are heaviest."""
        new, shard_of = self.shards, dict(self.shard_of)
        totals = [*self.totals(loads), 0]
        goal = sum(totals) / (new + 1)
        for slot, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
            giver = shard_of[slot]
            if totals[giver] - load >= goal and totals[new] + load <= goal:
                shard_of[slot] = new
                totals[giver] -= load
                totals[new] += load
        return SlotMap(shard_of, new + 1, self.version + 1)

    def rebalanced(self, loads: dict[int, int], tolerance: float = TOLERANCE) -> SlotMap:
        """The next version for new loads: units go one by one from the heaviest to the lightest shard, the one nearest to half
        their difference first, until all shards are within the tolerance of the mean or no move helps."""
        shard_of, totals = dict(self.shard_of), self.totals(loads)
        mean = sum(totals) / self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in totals]
        for unit, load in loads.items():
            held[shard_of[unit]].append((load, unit))
        for own in held:
            own.sort()
        while True:
            top, low = max(range(self.shards), key=totals.__getitem__), min(range(self.shards), key=totals.__getitem__)
            gap = totals[top] - totals[low]
            if max(totals[top] - mean, mean - totals[low]) <= mean * tolerance:
                break
            at = bisect.bisect_left(held[top], (gap / 2, -1))
            near = [x for x in held[top][max(at - 1, 0) : at + 1] if 0 < x[0] < gap]
            if not near:
                break
            load, unit = min(near, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
            held[top].remove((load, unit))
            bisect.insort(held[low], (load, unit))
            shard_of[unit] = low
            totals[top] -= load
            totals[low] += load
        return SlotMap(shard_of, self.shards, self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, unit, shard) for unit, shard in sorted(self.shard_of.items())]
        return spark.createDataFrame(rows, MAP)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the map's table, partitioned by version; earlier versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        rows = spark.read.schema(MAP).parquet(folder)
        version = version or rows.agg(F.max("version")).first()[0]
        rows = rows.where(F.col("version") == version).collect()
        shard_of = {r.unit: r.shard for r in rows}
        return cls(shard_of, max(shard_of.values()) + 1, version)


def loads_of(records: DataFrame) -> dict[int, int]:
    """Bytes by slot: at most one number for each slot reaches the driver."""
    return {r.virtual_slot: r.bytes for r in slot_loads(records).collect()}


def parts_of(loads: dict[int, int], shards: int) -> dict[int, int]:
    """How many parts each heavy slot is split into; slots that are not named stay whole."""
    grain = max(1, sum(loads.values()) // (shards * GRAIN))
    return {slot: -(-load // grain) for slot, load in loads.items() if load > grain}


def in_units(records: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``records`` with unit: the slot, and for the records of a split slot one of its parts, by a hash of their number."""
    unit = F.col("virtual_slot").cast("long")
    if not parts:
        return records.withColumn("unit", unit)
    split = F.broadcast(records.sparkSession.createDataFrame(sorted(parts.items()), "virtual_slot int, parts long"))  # at most GRAIN a shard
    part = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0))
    return records.join(split, "virtual_slot", "left").withColumn("unit", unit + part * SLOTS).drop("parts")


def unit_loads(records: DataFrame) -> dict[int, int]:
    """Bytes by unit: as many numbers as the map has."""
    return {r.unit: r.bytes for r in records.groupBy("unit").agg(F.sum("size").alias("bytes")).collect()}


def place(records: DataFrame, at: SlotMap) -> DataFrame:
    """``records`` with shard and slot, a record's gapless place in its shard.

    Places are counted in two steps, so that no shard is sorted as a whole: the rows of the shard's
    earlier units, then the row's number in its own unit.  A unit is numbered by hashed parts.
    """
    spark = records.sparkSession
    parts = records.withColumn("part", F.pmod(F.xxhash64("rid", "unit"), F.lit(16)).cast("int"))
    held = parts.groupBy("unit", "part").agg(F.count("*").alias("rows")).collect()
    first: dict[int, int] = {}
    starts = []
    for r in sorted(held, key=lambda r: (r.unit, r.part)):
        shard = at.shard_of[r.unit]
        starts.append((r.unit, r.part, shard, first.get(shard, 0)))
        first[shard] = first.get(shard, 0) + r.rows
    starts = F.broadcast(spark.createDataFrame(starts, "unit long, part int, shard int, first long"))  # 16 a unit at most
    w = "row_number() OVER (PARTITION BY unit, part ORDER BY rid) - 1"
    numbered = parts.withColumn("number", F.expr(w)).join(starts, ["unit", "part"])
    return numbered.withColumn("slot", F.col("first") + F.col("number")).drop("first", "number", "part", "rid")


def shard_documents(docs: DataFrame, shards: int = 24) -> tuple[DataFrame, list[SlotMap]]:
    """Every document with its shard, and the versions of the map; the law is ``bytes``: sizes per shard nearly equal.

    ``docs`` needs doc_id and text; other columns are ignored.  NULL texts count 8 bytes and crc32 0.  The key is doc_id
    and the text's checksum, so repeated ids with different texts spread; rows that are equal in both share a slot, which is
    split into parts where it is heavy.  The map's versions: slots dealt round; with the parts of hot slots, if there
    are any; moved by the measured bytes, which is what ``shard`` follows; with one more shard, which is ``next_shard``.
    """
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary"))
    records = docs.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"))
    records = records.withColumn("virtual_slot", slot_of(F.struct("doc_id", "text_crc32"), SLOTS))
    records = written(records.withColumn("rid", F.monotonically_increasing_id()), "records")
    records = in_units(records, parts_of(loads_of(records), shards))
    loads = unit_loads(records)
    maps = [SlotMap.dealt(SLOTS, shards)]
    parted = maps[0].split(loads)
    maps += [parted] if parted is not maps[0] else []
    maps.append(parted.rebalanced(loads))
    maps.append(maps[-1].grown(loads))
    moved = [u for u, s in maps[-1].shard_of.items() if s != maps[-2].shard_of[u]]
    placed = place(records, maps[-2])
    law = F.lit("bytes").alias("law")
    nothing = F.lit(None).cast("int").alias("grown_shard")
    goes = F.when(F.col("unit").isin(moved), F.lit(shards)).otherwise(F.col("shard")) if moved else F.col("shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", nothing, "virtual_slot", "unit", goes.alias("next_shard")), maps
