"""Sharding by fixed virtual slots, with DataFrame functions only.

Every record is hashed into one of thousands of virtual slots; a small versioned table maps slots to shards. Adding a
shard or rebalancing edits the table and moves whole slots, never single records. All tables that are broadcast or
collected here have a size fixed by the number of slots, not by the data.

Cases: a null doc_id hashes to one fixed slot; null text counts no bytes (size 1, checksum of no bytes 0); repeated rows
all keep a place of their own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, shared_dir

SLOTS = 4096
#: A slot's records are numbered in parts of about so many rows.
PART_ROWS = 50_000


def virtual_slot(key, slots: int = SLOTS):
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: (version, virtual_slot, shard); as many slots for each shard, decided by the two numbers alone."""
    return spark.range(0, slots, 1, 1).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with shard number `shards` added: it takes slots from the shards with most, and no other slot moves."""
    n = slot_map.count()
    own = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot", "version"), "virtual_slot")
    ranked = slot_map.withColumn("rank", F.row_number().over(own))
    taken = F.row_number().over(Window.orderBy(F.desc("rank"), "shard")) <= n // (shards + 1)
    return ranked.withColumn("taken", taken).select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("taken"), shards).otherwise(F.col("shard")).cast("int").alias("shard"))


def slot_sizes(records: DataFrame, size: str = "size") -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum(size).alias("slot_bytes"), F.count("*").alias("slot_rows"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The next version, edited by the bytes of each slot: slots go from the heaviest shard to the lightest until the two
    differ by no more than `tolerance` of the mean, or no single slot brings them closer.

    The table has one row for each slot; the driver edits it."""
    spark = slot_map.sparkSession
    rows = slot_map.join(F.broadcast(sizes), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("slot_bytes", F.lit(0)).alias("b")).orderBy("virtual_slot").collect()
    if not rows:
        return slot_map
    held: dict[int, dict[int, int]] = {}
    for r in rows:
        held.setdefault(r["shard"], {})[r["virtual_slot"]] = r["b"]
    load = {s: sum(v.values()) for s, v in held.items()}
    mean = max(1.0, sum(load.values()) / len(load))
    for _ in range(4 * len(rows)):
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if gap <= tolerance * mean:
            break
        fit = heapq.nsmallest(1, ((abs(gap - 2 * b), slot) for slot, b in held[high].items() if 0 < b < gap))
        if not fit:
            break
        b = held[high].pop(slot := fit[0][1])
        held[low][slot] = b
        load[high], load[low] = load[high] - b, load[low] + b
    at = {slot: s for s, slots in held.items() for slot in slots}
    listed = F.split(F.lit(",".join(str(at[r["virtual_slot"]]) for r in rows)), ",")
    one = spark.range(0, 1, 1, 1)
    return one.select(F.posexplode(listed).alias("virtual_slot", "shard")).select(F.lit(rows[0]["version"] + 1).alias("version"), "virtual_slot", F.col("shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add versions to a stored map. A version that is there is replaced by the new rows, so that a run that is tried again
    leaves what one run does; others stay."""
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the latest one if none is named."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).select("version", "virtual_slot", "shard")


def records(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), virtual_slot("doc_id", slots).alias("virtual_slot"))


def place(rows: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds the shard, and `slot`: the place in the shard, without gaps from 0, by virtual slot and then by key.

    Places need no sort of a shard: each part of a slot is numbered by itself and begins where the parts before it end.
    Equal records are counted before they meet and get their places in one go, so that a repeated one is one row."""
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    parts = max(1, -(-rows.count() // (slots * PART_ROWS)))
    each = each.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    mapped = each.join(F.broadcast(slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"))), "virtual_slot")
    counts = mapped.groupBy("shard", "virtual_slot", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    own = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = mapped.withColumn("rank", F.coalesce(F.sum("n").over(own), F.lit(0))).join(begins, ["virtual_slot", "part"])
    first = F.col("begins") + F.col("rank")
    return ranked.withColumn("slot", F.explode(F.sequence(first, first + F.col("n") - 1))).drop("begins", "rank", "part", "n")


def shard_documents(documents: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Places of all documents under the law `key`: the id and the number of shards decide. grown_shard is the shard with
    one shard more; rebalanced_shard the shard after an edit of the map by bytes.

    The map is stored (in the shared folder, if no path is given) and read again: version 1 as it began, version 2 with
    one shard more; the edit by bytes is made of version 1 and stored beside them as version 3."""
    spark = documents.sparkSession
    rows = records(documents, slots)
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    save_map(initial_map(spark, shards, slots), path)
    first = load_map(spark, path, 1)
    save_map(grow(first, shards), path)
    sizes = materialize(slot_sizes(rows), "slot-sizes")
    save_map(rebalance(first, sizes).withColumn("version", F.lit(3)), path)
    grown = load_map(spark, path, 2).select("virtual_slot", F.col("shard").alias("grown_shard"))
    edited = load_map(spark, path, 3).select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    more = first.select("virtual_slot").join(F.broadcast(grown), "virtual_slot").join(F.broadcast(edited), "virtual_slot").join(F.broadcast(sizes.drop("slot_rows")), "virtual_slot")
    out = place(rows, first, slots).join(F.broadcast(more), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes", "rebalanced_shard", "map_version")
