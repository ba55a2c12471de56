"""Shards by fixed virtual slots.

Every record hashes into one of a few thousand slots; the slot never changes.
A small versioned map says which shard owns each slot, and rebalancing or growing
edits that map only: records move slot by slot, and no record is hashed anew.

A slot that one id, or rows without any, make heavier than ``HEAVY`` of a shard can't be
balanced by moving slots. The map lists such slots as spread: their rows are dealt over all
slots by their number in the stored table, so shards stay equal whatever one id holds.

Defined results: a null text has size 1 and crc32 0; a null id is dealt by its
text; repeated rows share a slot unless it is spread, and get places of their own; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Slots of a map. The map is broadcast, so this is also the bound of what is broadcast.
SLOTS = 4096
#: Share of a shard's bytes from which a slot of several rows is spread.
HEAVY = 1 / 64
#: Rows of one slot that one part numbers, so that one hot slot is not one task's work.
PART_ROWS = 1_000_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each slot; ``owner[i]`` is the shard of slot ``i``."""

    version: int
    shards: int
    owner: tuple[int, ...]
    spread: frozenset[int] = frozenset()

    def moved(self, other: SlotMap) -> list[int]:
        return [i for i, (a, b) in enumerate(zip(self.owner, other.owner, strict=True)) if a != b]


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """The first version: slots dealt in turn."""
    return SlotMap(1, shards, tuple(i % shards for i in range(slots)))


def rebalanced(old: SlotMap, load: dict[int, int]) -> SlotMap:
    """The next version: slots move from the heaviest to the lightest shard while that narrows the gap.

    Each edit moves the slot whose load is nearest to half the gap, or swaps two
    slots when no single move helps. Terminates, as the sum of squares falls.
    """
    owner = list(old.owner)
    held = [[] for _ in range(old.shards)]
    total = [0] * old.shards
    for slot, shard in enumerate(owner):
        if load.get(slot):
            held[shard].append(slot)
            total[shard] += load[slot]
    while True:
        high = max(range(old.shards), key=lambda s: (total[s], -s))
        low = min(range(old.shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        single = [s for s in held[high] if load[s] < gap]
        if single:
            slot = min(single, key=lambda s: (abs(2 * load[s] - gap), s))
            held[high].remove(slot)
            held[low].append(slot)
            total[high] -= load[slot]
            total[low] += load[slot]
            owner[slot] = low
            continue
        best = None
        ordered = sorted(held[low], key=lambda s: (load[s], s))
        for a in held[high]:
            for b in ordered:
                d = load[a] - load[b]
                if 0 < d < gap and (best is None or abs(2 * d - gap) < best[0]):
                    best = (abs(2 * d - gap), a, b)
            if best and best[0] <= 1:
                break
        if best is None:
            break
        _, a, b = best
        held[high][held[high].index(a)] = b
        held[low][held[low].index(b)] = a
        total[high] -= load[a] - load[b]
        total[low] += load[a] - load[b]
        owner[a], owner[b] = low, high
    return SlotMap(old.version + 1, old.shards, tuple(owner), old.spread)


def grown(old: SlotMap, load: dict[int, int] | None = None) -> SlotMap:
    """The next version with one more shard, which takes slots from the others; no slot moves between old shards."""
    load = load or {}
    weight = lambda s: load.get(s, 0) if load else 1
    owner, new = list(old.owner), old.shards
    total = [0] * new
    for slot, shard in enumerate(owner):
        total[shard] += weight(slot)
    goal = sum(total) / (new + 1)
    taken = 0
    for slot in sorted(range(len(owner)), key=lambda s: (-weight(s), s)):
        shard = owner[slot]
        w = weight(slot)
        if w and taken + w <= goal + 0.5 and total[shard] - w >= goal - max(1, w):
            owner[slot], taken, total[shard] = new, taken + w, total[shard] - w
    return SlotMap(old.version + 1, new + 1, tuple(owner), old.spread)


def slot_of(id_column: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    key = F.when(F.col(id_column).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(id_column)))
    return F.pmod(key, F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per record: id, virtual slot, size in bytes plus 1, crc32. The text goes no further than the scan."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_column).alias("doc_id"),
        slot_of(id_column, text, slots).alias("virtual_slot"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; at most one row a slot."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def map_frame(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    rows = [(slot_map.version, slot, shard, slot in slot_map.spread) for slot, shard in enumerate(slot_map.owner)]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, spread boolean")


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Appends the version to the map table; earlier versions stay readable."""
    map_frame(spark, slot_map).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the stored map, the latest by default."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).select("virtual_slot", "shard", "spread").orderBy("virtual_slot").collect()
    owner = tuple(r["shard"] for r in rows)
    return SlotMap(int(version), max(owner) + 1, owner, frozenset(r["virtual_slot"] for r in rows if r["spread"]))


def numbered(records: DataFrame) -> DataFrame:
    """Records with a number of their own (``_row``); it holds where they are kept afterwards."""
    return records.withColumn("_row", F.monotonically_increasing_id())


def spread_slots(loads: DataFrame, shards: int) -> frozenset[int]:
    """Slots of several rows that are heavier than ``HEAVY`` of a shard, from the loads (at most one row a slot)."""
    rows = loads.collect()
    total = sum(r["bytes"] for r in rows)
    return frozenset(r["virtual_slot"] for r in rows if r["rows"] > 1 and r["bytes"] * shards > total * HEAVY)


def respread(records: DataFrame, spread: frozenset[int], slots: int = SLOTS) -> DataFrame:
    """Numbered records, those of spread slots dealt over all slots by their number."""
    if not spread:
        return records
    anywhere = F.pmod(F.xxhash64("_row"), F.lit(slots)).cast("int")
    return records.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(*sorted(spread)), anywhere).otherwise(F.col("virtual_slot")))


def assign(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Records with their shard and a gapless place (``slot``) in it, from 0.

    Places come from counts per (slot, part), one for each slot and each million rows,
    plus the row's number in its part; no shard is sorted as a whole. Rows get a number
    of their own and are kept in the shared folder, unless they are already; the number
    deals equal rows over the parts.
    """
    spark, names = records.sparkSession, [c for c in records.columns if c != "_row"]
    records = records if "_row" in records.columns else cut(numbered(records))
    sizes = {r[0]: -(-r[1] // PART_ROWS) for r in records.groupBy("virtual_slot").count().collect()}
    parts = spark.createDataFrame(sorted(sizes.items()), "virtual_slot int, _parts int")
    dealt = records.join(F.broadcast(parts), "virtual_slot").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    counts = {(r[0], r[1]): r[2] for r in dealt.groupBy("virtual_slot", "_part").count().collect()}
    place, rows = [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.owner):
        for p in range(sizes.get(slot, 0)):
            rows.append((slot, p, shard, place[shard]))
            place[shard] += counts.get((slot, p), 0)
    start = spark.createDataFrame(rows, "virtual_slot int, _part int, shard int, _start long")
    order = Window.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size", "_row")
    placed = dealt.withColumn("_n", F.row_number().over(order)).join(F.broadcast(start), ["virtual_slot", "_part"])
    return placed.select(*names, "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """All records in shards of nearly equal bytes, and the map that says so (version 2, edited from the even one)."""
    records = cut(numbered(measured(docs, slots=slots)))
    first = even_map(shards, slots)
    spread = spread_slots(slot_loads(records), shards)
    records = respread(records, spread, slots)
    load = {r["virtual_slot"]: r["bytes"] for r in slot_loads(records).collect()}
    slot_map = rebalanced(SlotMap(first.version, shards, first.owner, spread), load)
    return assign(records, slot_map), slot_map


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slot_map = shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
