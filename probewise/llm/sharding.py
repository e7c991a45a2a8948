"""Shards through fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from probewise.llm.shared import row_of, whole_text
from probewise.workspace import shared_folder, written

SLOTS = 4096
SEED = "slots"


def size_of() -> Column:
    return F.octet_length(whole_text()).cast("long") + 1


def virtual_slot(slots: int = SLOTS) -> Column:
    """A record's slot: from its id and text only, so it never changes."""
    return F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(slots)).cast("int")


def slot_loads(slotted: DataFrame) -> DataFrame:
    """(virtual, bytes, rows): at most one row per virtual slot, summed before the shuffle."""
    return slotted.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(items: Column, start: Column) -> Column:
    """Give each of ``items`` (largest first) to the least loaded shard, as one fold."""
    def least(loads: Column) -> Column:
        return F.array_position(loads, F.array_min(loads)).cast("int")

    def give(state: Column, item: Column) -> Column:
        to = least(state["loads"])
        return F.struct(
            F.transform(state["loads"], lambda v, i: F.when(i == to - 1, v + item["bytes"]).otherwise(v)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(
                item["virtual"].alias("virtual"), (to - 1).alias("shard")))).alias("placed"))

    none = F.lit(None).cast("array<struct<virtual:int,shard:int>>")
    return F.aggregate(items, F.struct(start.alias("loads"), F.coalesce(none, F.array()).alias("placed")), give)["placed"]


def first_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, virtual, shard): heaviest slot first, each to the lightest shard so far.

    The input has one row per virtual slot, thousands by construction, so one array holds
    it. Ties go to the smaller slot and the lower shard.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual"))),
        lambda x: F.struct(x["virtual"].alias("virtual"), (-x["minus"]).alias("bytes")))
    start = F.array_repeat(F.lit(0).cast("long"), shards)
    return (
        loads.agg(ordered.alias("items"))
        .select(F.explode(_dealt(F.col("items"), start)).alias("x"))
        .select(F.lit(version).alias("version"), "x.virtual", "x.shard"))


def grown_map(old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``old`` for one more shard, ``shards`` in all: slots move only into the new one.

    Each old shard gives up slots, in the order of a hash, while what it has given stays within
    its share ``1 / shards`` of its bytes.
    """
    lay = W.partitionBy("shard").orderBy(F.xxhash64(F.lit("grow"), "virtual"), "virtual")
    whole = W.partitionBy("shard")
    return (
        old.join(loads.select("virtual", "bytes"), "virtual", "left")
        .withColumn("bytes", F.coalesce("bytes", F.lit(0)))
        .withColumn("given", F.sum("bytes").over(lay))
        .withColumn("share", F.sum("bytes").over(whole) / F.lit(shards))
        .select((F.col("version") + 1).alias("version"), "virtual",
                F.when(F.col("given") <= F.col("share"), F.lit(shards - 1)).otherwise(F.col("shard")).alias("shard")))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add one version of the map to the Parquet table at ``path``."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def rebalanced(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """``sharded`` by version 1 of a stored map, with ``map_version``, ``next_shard`` and ``text_group``.

    Both versions of the map are written to one table and read from there: version 2 is version 1 edited for one more shard, and
    ``next_shard`` is where it has the row, the same shard or the new one. ``text_group`` is alike for equal texts; these are not kept
    together, as one text may be a third of all rows and sizes are to be near equal.
    """
    path = f"{shared_folder(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}"
    loads = written(slot_loads(docs.select(size_of().alias("size"), virtual_slot(slots).alias("virtual"))), "slot-loads")
    write_map(first_map(loads, shards), path)
    stored = docs.sparkSession.read.schema("virtual int, shard int, version int").parquet(path)
    write_map(grown_map(stored.filter("version = 1"), loads, shards + 1), path)
    both = docs.sparkSession.read.schema("virtual int, shard int, version int").parquet(path)
    after = both.filter("version = 2").select("virtual", F.col("shard").alias("next_shard"))
    grouped = docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("text_group"))
    placed = sharded(grouped, shards, slots, both.filter("version = 1").select("virtual", "shard"), carry=["text_group"], loads=loads)
    return placed.join(F.broadcast(after), "virtual").select(  # one row per virtual slot
        "doc_id", "size", "text_crc32", "shard", "slot", F.lit(1).alias("map_version"), "next_shard", "row.text_group")


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, slot_map: DataFrame | None = None,
            carry: list[str] = (), loads: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual, shard, slot and ``row`` for every row of ``docs``.

    ``slot`` numbers the rows of a shard without gaps: a prefix sum over the virtual slots
    of the shard, then the place inside the slot, so nothing larger than one virtual slot
    is sorted. Without ``slot_map`` the map is made from the bytes of this input; ``loads`` are its ``slot_loads``, if known.

    A missing text has no bytes (size 1); rows repeated whole lie in one slot, side by
    side; a missing id is hashed as such with the text. Without rows there are none.
    """
    slotted = docs.select(
        "doc_id", size_of().alias("size"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"),
        virtual_slot(slots).alias("virtual"), row_of(list(carry)).alias("row"))
    loads = written(slot_loads(slotted.drop("row", "text_crc32")), "slot-loads") if loads is None else loads
    slot_map = written(first_map(loads, shards), "slot-map") if slot_map is None else slot_map
    before = W.partitionBy("shard").orderBy("virtual").rowsBetween(W.unboundedPreceding, -1)
    places = (
        slot_map.join(loads, "virtual")
        .select("virtual", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_place")))
    inside = W.partitionBy("virtual").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(places), "virtual")  # one row per virtual slot
        .select("doc_id", "size", "text_crc32", "virtual", "shard",
                (F.col("first_place") + F.col("place") - 1).alias("slot"), "row"))
