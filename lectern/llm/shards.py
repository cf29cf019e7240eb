"""Sharding by fixed virtual slots.

Rows hash into a fixed number of virtual slots; bytes and rows are summed per slot; a versioned map sends slots to
shards. Rebalancing edits the map, never the hash, so a row moves only if its slot does. Everything on the main path
is built-in Spark SQL; only the slot table (one row a slot, N_SLOTS at most) reaches the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import materialize

N_SLOTS = 8192
N_SHARDS = 16
#: Equal rows are made again from their count in runs of so many.
REPEATS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; moved: the slots that this version took from another shard."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def first(cls, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> SlotMap:
        """Version 1: the slots dealt out in equal runs."""
        return cls(1, n_shards, tuple(slot * n_shards // n_slots for slot in range(n_slots)))

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "n_shards": self.n_shards, "shard_of": self.shard_of, "moved": self.moved})

    @classmethod
    def from_json(cls, text: str) -> SlotMap:
        x = json.loads(text)
        return cls(x["version"], x["n_shards"], tuple(x["shard_of"]), tuple(x["moved"]))


def rebalance(old: SlotMap, weight: list[int]) -> SlotMap:
    """The next version: moves, then swaps, of slots between the heaviest and the lightest shard while that narrows their gap."""
    shard_of = list(old.shard_of)
    held: list[set[int]] = [set() for _ in range(old.n_shards)]
    load = [0] * old.n_shards
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].add(slot)

    def move(slot: int, to: int) -> None:
        at = shard_of[slot]
        held[at].discard(slot)
        held[to].add(slot)
        load[at] -= weight[slot]
        load[to] += weight[slot]
        shard_of[slot] = to

    for _ in range(4 * len(shard_of)):
        high = max(range(old.n_shards), key=lambda s: (load[s], -s))
        low = min(range(old.n_shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = min(((abs(gap - 2 * weight[s]), s) for s in held[high] if weight[s] < gap), default=None)
        if best:
            move(best[1], low)
            continue
        mine, theirs = sorted(held[high], key=lambda s: weight[s]), sorted(held[low], key=lambda s: weight[s])
        swap, j = None, 0
        for a in mine:  # both ascend, so the partner nearest to weight[a] - gap / 2 only moves up
            while j + 1 < len(theirs) and abs(2 * (weight[a] - weight[theirs[j + 1]]) - gap) <= abs(2 * (weight[a] - weight[theirs[j]]) - gap):
                j += 1
            if theirs and 0 < weight[a] - weight[theirs[j]] < gap:
                swap = min(swap or (gap, 0, 0), (abs(2 * (weight[a] - weight[theirs[j]]) - gap), a, theirs[j]))
        if not swap or swap[0] >= gap:
            break
        move(swap[1], low)
        move(swap[2], high)
    moved = tuple(slot for slot, (a, b) in enumerate(zip(old.shard_of, shard_of, strict=True)) if a != b)
    return SlotMap(old.version + 1, old.n_shards, tuple(shard_of), moved)


def grow(old: SlotMap, weight: list[int]) -> SlotMap:
    """The next version with one more shard, which takes its share of slots from the heaviest shards; no other slot moves."""
    shard_of, new = list(old.shard_of), old.n_shards
    load = [0] * (new + 1)
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
    share = sum(load) / (new + 1)
    for slot in sorted(range(len(shard_of)), key=lambda s: (-weight[s], s)):
        if load[shard_of[slot]] - weight[slot] >= share and load[new] + weight[slot] <= share:
            load[shard_of[slot]] -= weight[slot]
            load[new] += weight[slot]
            shard_of[slot] = new
    moved = tuple(slot for slot, shard in enumerate(shard_of) if shard == new)
    return SlotMap(old.version + 1, new + 1, tuple(shard_of), moved)


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version to the store at path; older versions stay."""
    spark.sql("SELECT :version AS version, :body AS body", args={"version": slot_map.version, "body": slot_map.to_json()}).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A stored version, the latest by default; None if there is no store or no such version."""
    try:
        stored = spark.read.schema("version int, body string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    stored = stored if version is None else stored.filter(F.col("version") == version)
    row = stored.orderBy(F.desc("version")).first()
    return SlotMap.from_json(row["body"]) if row else None


def _lookup(values: list[int], at: Column, kind: str) -> Column:
    """values[at], as a constant that the optimizer folds into one array."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), at)


def virtual_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, repeat and virtual_slot of each row. A null text has size 1 and counts as empty; null ids hash too.

    Rows equal in these three are numbered (repeat, from 0) and spread over slots like others. They are counted, with
    partial sums before the shuffle, and made again from the count, a large count in runs of REPEATS rows dealt over tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    counted = materialize(counted, "shard-counts")
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS)))
    few, many = counted.filter(F.col("n") <= REPEATS).withColumn("run", F.lit(0).cast("long")), counted.filter(F.col("n") > REPEATS).withColumn("run", run).repartition("run")
    last = F.least(F.col("n"), (F.col("run") + 1) * REPEATS) - 1
    made = few.unionByName(many).select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("run") * REPEATS, last)).alias("repeat"))
    return made.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "repeat"), F.lit(n_slots)).cast("int"))


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, current: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """Every row with its shard and its gapless position in that shard, by the law `bytes`: shards hold near equal bytes.

    current: the map to edit; default: the latest in the store, else version 1. store: where an edited version is
    appended; if nothing moves, there is no new version, so reruns agree.
    Null texts and null ids are kept like other rows, repeated rows get slots and positions of their own, columns other than doc_id
    and text are ignored, and an empty table gives an empty result. Rows of one virtual slot, a few thousandths of a shard, are numbered
    together; a slot's first position is the sum of its shard's earlier slots, so no task ever holds a shard.
    """
    slim = materialize(virtual_slots(docs, n_slots), "shard-rows")
    spark = docs.sparkSession
    stored = load_map(spark, store) if store and not current else None
    if stored and (stored.n_shards, len(stored.shard_of)) == (n_shards, n_slots):
        current = stored
    counted = slim.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # n_slots rows at most
    weight, count = [0] * n_slots, [0] * n_slots
    for row in counted:
        weight[row["virtual_slot"]], count[row["virtual_slot"]] = row["bytes"], row["n"]
    slot_map = rebalance(current or SlotMap.first(n_slots, n_shards), weight)
    if current and not slot_map.moved:
        slot_map = current
    elif store:
        save_map(spark, slot_map if stored is None else replace(slot_map, version=max(slot_map.version, stored.version + 1)), store)
    start, filled = [0] * n_slots, [0] * slot_map.n_shards
    for slot, shard in enumerate(slot_map.shard_of):
        start[slot] = filled[shard]
        filled[shard] += count[slot]
    slot = F.col("virtual_slot")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "repeat")) - 1
    return slim.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _lookup(list(slot_map.shard_of), slot, "int").alias("shard"),
        (within + _lookup(start, slot, "bigint")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )
