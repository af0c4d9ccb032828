"""Sharding by fixed virtual slots.

A record's hash names one of some thousand virtual slots for good. Which shard holds a slot is said by a map,
a stored table with a version. Rebalancing counts the bytes of each slot and edits the map: slots move
from the fullest shards until sizes are near equal, and the edited map is the next version. Growing by a shard
moves slots into the new shard only. Records are never rehashed, and only those of moved slots change their shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingflow.llm.common import scratch_dir, stored

SHARDS = 8
#: Virtual slots. The map and the bytes by slot, which the driver holds, have so many rows, whatever the input.
SLOTS = 4096
#: Shares of a slot that are numbered apart, so that a slot with much of the table is not one task's.
PARTS = 16
#: Rebalancing stops when no shard has more than its equal share by this part of it.
TOLERANCE = 0.001

_MAP = "slot int, shard int, version int"


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: a hash of its id and text. Rows equal in both are one record."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


# --- the map -----------------------------------------------------------------------------------------

def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """The shard of each slot before anything is known of their sizes."""
    return [slot % shards for slot in range(slots)]


def rebalanced(shard_of: Sequence[int], load: Sequence[int], shards: int = SHARDS,
               tolerance: float = TOLERANCE) -> list[int]:
    """The map edited so that the loads of shards are near equal; slots that need not move stay.

    Shards above the equal share give away the largest slots that fit their surplus, and those go, largest first,
    to the shard with the least. Then slots of the fullest shard move to the emptiest, or change
    places with one there, while that brings the two nearer. A slot larger than a share has a shard to itself.
    """
    shard_of = list(shard_of)
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        total[shard] += load[slot]
        held[shard].append(slot)
    share = sum(total) / shards
    if all(abs(n - share) <= share * tolerance for n in total):
        return shard_of
    loose = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-load[s], s)):
            if load[slot] and total[shard] - load[slot] >= share:
                total[shard] -= load[slot]
                held[shard].remove(slot)
                loose.append(slot)
    emptiest = [(n, shard) for shard, n in enumerate(total)]
    heapq.heapify(emptiest)
    for slot in sorted(loose, key=lambda s: (-load[s], s)):
        n, shard = heapq.heappop(emptiest)
        heapq.heappush(emptiest, (n + load[slot], shard))
        total[shard] += load[slot]
        held[shard].append(slot)
    for _ in range(4 * len(shard_of)):
        high = max(range(shards), key=lambda s: (total[s], -s))
        low = min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        if total[high] <= share * (1 + tolerance) and total[low] >= share * (1 - tolerance):
            break
        # What the move or swap takes over should be half the gap; anything between 0 and the gap helps.
        best, swap = gap, None
        there = sorted([*((load[s], s) for s in held[low]), (0, -1)])
        for slot in held[high]:
            at = 0
            left, right = 0, len(there) - 1
            while left <= right:  # the last partner that leaves half the gap at least
                middle = (left + right) // 2
                if 2 * (load[slot] - there[middle][0]) >= gap:
                    at, left = middle, middle + 1
                else:
                    right = middle - 1
            for n, other in there[at:at + 2]:
                miss = abs(gap - 2 * (load[slot] - n))
                if miss < best:
                    best, swap = miss, (slot, other)
        if swap is None:
            break
        for slot, origin, goal in ((swap[0], high, low), (swap[1], low, high)):
            if slot >= 0:
                held[origin].remove(slot)
                held[goal].append(slot)
                total[origin] -= load[slot]
                total[goal] += load[slot]
    for shard in range(shards):
        for slot in held[shard]:
            shard_of[slot] = shard
    return shard_of


def grown(shard_of: Sequence[int], load: Sequence[int], shards: int) -> list[int]:
    """The map with one more shard, number ``shards``; slots move into it only.

    It takes slots from whichever shard has most until it has an equal share.
    """
    shard_of = list(shard_of)
    share = sum(load) / (shards + 1)
    total = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        total[shard] += load[slot]
        held[shard].append((load[slot], slot))
    for slots in held:
        slots.sort()
    taken = 0
    while any(held):
        shard = max((s for s in range(shards) if held[s]), key=lambda s: (total[s], -s))
        n, slot = held[shard].pop()
        if not n:
            held[shard] = []
        elif 2 * (share - taken) >= n:  # nearer to an equal share with it than without
            taken += n
            total[shard] -= n
            shard_of[slot] = shards
        if taken >= share:
            break
    return shard_of


def write_map(spark: SparkSession, path: str, shard_of: Sequence[int], version: int) -> None:
    """Stores a version of the map. Versions are never changed, so a version that is there is an error."""
    rows = spark.createDataFrame(list(enumerate(shard_of)), "slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> list[int]:
    """The shard of each slot by a stored version."""
    rows = spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}").collect()
    return [shard for _, shard in sorted((r["slot"], r["shard"]) for r in rows)]


# --- records -----------------------------------------------------------------------------------------

def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, ``virtual_slot`` and ``part`` of every row; size is UTF-8 bytes (null: none) plus 1.

    ``part`` is a share of the slot that depends on where a row was read. Store the result before it is used twice.
    """
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), text, slots).alias("virtual_slot"),
        F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"))


def slot_loads(records: DataFrame) -> DataFrame:
    """``n`` records and ``bytes`` of every virtual slot and part that has any: ``SLOTS * PARTS`` rows at most."""
    return records.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def bytes_by_slot(loads: DataFrame, slots: int = SLOTS) -> list[int]:
    """The bytes of each virtual slot; a number per slot reaches the driver."""
    found = {r["virtual_slot"]: r["bytes"] for r in
             loads.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()}
    return [found.get(slot, 0) for slot in range(slots)]


def assign(records: DataFrame, loads: DataFrame, shard_of: Sequence[int]) -> DataFrame:
    """``records`` with ``shard`` by the map and ``slot``, the row's place in its shard from 0 without gaps.

    Places go by virtual slot, part, id and text. Each virtual slot and part is numbered on its own and shifted by those
    before it in the shard; the table of shifts has ``SLOTS * PARTS`` rows at most and is broadcast.
    """
    spark = records.sparkSession
    mapping = spark.createDataFrame(list(enumerate(shard_of)), "virtual_slot int, shard int")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = loads.join(F.broadcast(mapping), "virtual_slot").select(
        "virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("virtual_slot", "part").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return records.withColumn("at", F.row_number().over(inside)) \
        .join(F.broadcast(shifts), ["virtual_slot", "part"]) \
        .withColumn("slot", (F.col("before") + F.col("at") - 1).cast("long")).drop("before", "at")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, ``law``, ``shard``, ``slot``, grown_shard and virtual_slot of every row.

    The map's version 0 deals slots in turn; version 1 is that edited for the bytes found, and is what holds. Both are
    stored below ``path``. The law is ``bytes``: shards have near equal sizes, as near as whole slots allow, so grown_shard is null
    (``grown`` edits the map for one more shard). A null text has size 1 and the checksum of the empty text. Rows
    without an id are dealt by their text. Repeated rows share a virtual slot and each get a place. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "slot-map")
    records = stored(sized(docs, slots), "records")
    loads = stored(slot_loads(records), "slot-loads")
    write_map(spark, path, first_map(slots, shards), 0)
    write_map(spark, path, rebalanced(read_map(spark, path, 0), bytes_by_slot(loads, slots), shards), 1)
    placed = assign(records, loads, read_map(spark, path, 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
