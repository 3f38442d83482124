"""Shards by fixed virtual slots.

Records are hashed into thousands of virtual slots, whose number never changes. Bytes are summed for each
slot, and a versioned table maps slots to shards. Rebalancing edits that table: a shard above its share hands
its smallest slots on, the rest stay. Moving a slot moves all its records and no others.

Defined results: a null text has no bytes but counts as a record; null ids hash like any value; rows that
repeat are records of their own with places of their own; an empty input gives an empty result (the map still
has every slot); other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindsight.llm.text import whole
from hindsight.session import cut_lineage

#: Virtual slots; the slot table has this many rows at any input size.
SLOTS = 6144
#: Parts of a slot within which places are counted, so that places need no sort of a whole shard.
PARTS = 16
#: Bytes that a record takes besides its text.
OVERHEAD = 8


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, part: one narrow row for each record; slot is ``part % SLOTS``."""
    facts = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(whole(text_col)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole(text_col).cast("binary")).alias("text_crc32"),
    )
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLOTS * PARTS))
    return cut_lineage(facts.withColumn("part", part.cast("int")))


def slot_of(part: str = "part") -> Column:
    return (F.col(part) % SLOTS).cast("int")


def slot_bytes(found: DataFrame) -> DataFrame:
    """vslot, bytes for all slots, empty ones with 0."""
    summed = found.groupBy(slot_of().alias("vslot")).agg(F.sum("size").alias("bytes"))
    every = found.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("vslot"))
    return every.join(summed, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    slot = F.col("id").cast("int")
    return spark.range(SLOTS).select(F.lit(1).alias("version"), slot.alias("vslot"), (slot % shards).alias("shard"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` for ``loads`` (vslot, bytes).

    Each shard keeps its largest slots while they fit its even share; what is left over goes, largest
    first, to the shard with the least bytes. The fold runs over slots, of which there are ``SLOTS``.
    """
    down = [F.col("bytes").desc(), F.col("vslot")]
    held = slot_map.join(loads, "vslot").withColumn("share", F.sum("bytes").over(Window.partitionBy("version")) / shards)
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*down).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("shard").orderBy(*down)) == 1
    held = held.withColumn("stays", first | (upto <= F.col("share"))).withColumn("stays", F.col("stays") & (F.col("shard") < shards))
    one = held.groupBy("version").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0).cast("long")) for s in range(shards)]).alias("loads"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("bytes"), "vslot")))).alias("loose"),
    )
    placed = one.selectExpr(
        "version",
        """aggregate(loose, struct(loads as loads, cast(array() as array<int>) as at),
             (s, x) -> struct(
               transform(s.loads, (b, i) -> if(i = array_position(s.loads, array_min(s.loads)) - 1, b - x.bytes, b)) as loads,
               array_append(s.at, cast(array_position(s.loads, array_min(s.loads)) - 1 as int)) as at),
             s -> arrays_zip(s.at, transform(loose, x -> x.vslot))) as moved""",
    ).select("version", F.inline("moved").alias("to", "vslot"))
    edited = held.join(placed, ["version", "vslot"], "left")
    return edited.select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, map): each record's shard and its place there, and all versions of the slot map.

    Rows: doc_id, size, text_crc32, vslot, shard, slot (the place in the shard, gapless from 0).
    """
    found = records(docs, id_col, text_col)
    first = first_map(docs.sparkSession, shards)
    versions = cut_lineage(first.unionByName(rebalance(first, slot_bytes(found), shards)))
    latest = versions.where(F.col("version") == 2).select("vslot", "shard")
    # where each part begins in its shard: a running sum over SLOTS * PARTS counts at most
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("vslot", slot_of()).join(latest, "vslot")
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("part", "vslot", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    within = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32")
    placed = found.withColumn("k", F.row_number().over(within)).join(F.broadcast(begins), "part")
    rows = placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("begin") + F.col("k") - 1).cast("long").alias("slot"))
    return rows, versions
