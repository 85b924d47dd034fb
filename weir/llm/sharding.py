"""Sharding by fixed virtual slots, in DataFrame operations only.

Records hash into a fixed number of virtual slots. Rows and bytes are summed for each
slot, a versioned map says which shard owns each slot, and rebalancing edits the map
and never the hash. The number of slots is a parameter, so what reaches the driver (a
row for each slot) and what is broadcast (the map) have a bound that no input changes.

Copies of a text are a group that may hold a third of all rows. Sizes are to be near
equal, so copies are not kept together: the id is hashed too, which spreads them over all
slots. Only rows equal in id and text share a slot.

Null ids and null texts are hashed like any value; a null text has size `overhead`. Very
long texts only weigh more. Ties of places go by id, checksum and size.
An empty table gives an empty result. Extra columns are ignored. Repeated rows are
rows of their own; each has its own place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import read_table, shared_path

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """shard_of[v] is the shard of virtual slot v."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    def weights(self, loads: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for v, shard in enumerate(self.shard_of):
            out[shard] += loads[v]
        return out


def plan_map(loads: list[int], n_shards: int) -> SlotMap:
    """Version 1: heaviest slot first, each to the lightest shard."""
    total, owner = [(0, s) for s in range(n_shards)], [0] * len(loads)
    import heapq

    heapq.heapify(total)
    for v in sorted(range(len(loads)), key=lambda v: (-loads[v], v)):
        weight, shard = heapq.heappop(total)
        owner[v] = shard
        heapq.heappush(total, (weight + loads[v], shard))
    return SlotMap(1, n_shards, tuple(owner))


def rebalance(old: SlotMap, loads: list[int], moves: int = 10_000) -> SlotMap:
    """Edit the map: hand slots, or swap them, from the heaviest to the lightest shard
    while that narrows the gap between the two."""
    owner = list(old.shard_of)
    weight = old.weights(loads)
    moved = set()
    for _ in range(moves):
        hi, lo = max(range(old.n_shards), key=lambda s: (weight[s], -s)), min(range(old.n_shards), key=lambda s: (weight[s], s))
        gap = weight[hi] - weight[lo]
        ours = sorted((loads[v], v) for v in range(len(owner)) if owner[v] == hi and loads[v])
        theirs = sorted((loads[v], v) for v in range(len(owner)) if owner[v] == lo and loads[v])
        best, at = gap, None
        for a, v in ours:
            for b, u in [(0, -1), *theirs]:
                left = abs(gap - 2 * (a - b))
                if 0 < a - b < gap and left < best:
                    best, at = left, (a, v, b, u)
            if best <= gap // 8:
                break
        if at is None:
            break
        a, v, b, u = at
        owner[v], weight[hi], weight[lo] = lo, weight[hi] - a + b, weight[lo] + a - b
        moved.add(v)
        if u >= 0:
            owner[u] = hi
            moved.add(u)
        if weight[hi] == weight[lo]:
            break
    return SlotMap(old.version + 1, old.n_shards, tuple(owner), tuple(sorted(moved)))


def grow(old: SlotMap, loads: list[int]) -> SlotMap:
    """One shard more: slots move into the new shard only, taken from whichever shard is
    the heaviest, until it holds its share."""
    owner, weight, new = list(old.shard_of), old.weights(loads) + [0], old.n_shards
    goal = sum(weight) / (new + 1)
    slots = {s: sorted((loads[v], v) for v in range(len(owner)) if owner[v] == s and loads[v]) for s in range(new)}
    while True:
        hi = max(range(new), key=lambda s: (weight[s], -s))
        room = goal - weight[new]
        fit = [x for x in slots[hi] if x[0] <= room]
        if not fit:
            break
        load, v = fit[-1]
        slots[hi].remove((load, v))
        owner[v], weight[hi], weight[new] = new, weight[hi] - load, weight[new] + load
    return SlotMap(old.version + 1, new + 1, tuple(owner), tuple(v for v, s in enumerate(owner) if s == new))


def store_map(spark: SparkSession, path: str, slots: SlotMap) -> None:
    map_frame(spark, slots).withColumn("version", F.lit(slots.version)).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The stored map of that version, or the newest; a row for each slot."""
    df = spark.read.parquet(path)
    version = df.agg(F.max("version")).first()[0] if version is None else version
    rows = df.where(F.col("version") == version).orderBy("v_slot").collect()
    return SlotMap(version, max(r.shard for r in rows) + 1, tuple(r.shard for r in rows))


def map_frame(spark: SparkSession, slots: SlotMap, base: list[int] | None = None) -> DataFrame:
    """(v_slot, shard[, base]) from a literal; as many rows as there are slots."""
    cols = [F.from_json(F.lit(json.dumps(list(x))), "array<bigint>") for x in (slots.shard_of, base or [])]
    df = spark.range(1).select(F.posexplode(F.arrays_zip(*[c.alias(n) for c, n in zip(cols[: 1 + bool(base)], ("shard", "base"))])).alias("v_slot", "of"))
    return df.select("v_slot", F.col("of.shard").cast("int").alias("shard"), *([F.col("of.base").alias("base")] if base else []))


def sized_records(docs: DataFrame, n_slots: int = SLOTS, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return df.withColumn("v_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def slot_loads(records: DataFrame, n_slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; one row a slot comes to the driver."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("v_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.v_slot], rows[r.v_slot] = r.b, r.n
    return size, rows


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every record: its shard, by the map in force, and a gapless place in the
    shard. The place is the rank within the virtual slot on top of what the shard's
    earlier slots hold, so no task ever sees more than one slot's rows."""
    spark = docs.sparkSession
    records = sized_records(docs, n_slots)
    size, rows = slot_loads(records, n_slots)
    path = map_path or shared_path(spark, "slot-map")
    store_map(spark, path, first := plan_map(size, n_shards))
    store_map(spark, path, edited := rebalance(first, size))
    base, next_free = [0] * n_slots, [0] * n_shards
    for v, owner in enumerate(edited.shard_of):
        base[v] = next_free[owner]
        next_free[owner] += rows[v]
    within = Window.partitionBy("v_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("rank", F.row_number().over(within).cast("bigint"))
    owners = F.broadcast(map_frame(spark, edited, base))  # n_slots rows, whatever the input
    return placed.join(owners, "v_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), "v_slot", F.lit(edited.version).alias("map_version"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = shard(read_table(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "v_slot", "map_version")
