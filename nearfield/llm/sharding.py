"""Sharding over fixed virtual slots, in DataFrame functions alone.

A record's slot is a hash of its key into a fixed number of slots. Bytes and rows are summed by slot, with partial sums
before the shuffle, so a table of SLOTS rows is all that decides. The map from slot to shard is a small versioned table:
the first version gives each slot, the largest first, to the shard of the fewest bytes; later versions are edits that
move as few slots as bring the shards back within a tolerance, or that fill new shards. Records move only if their
slot's entry changes.

The law kept is ``bytes``: shard sizes are near equal, as hashing splits every hot source or group of copies over all
slots. Rows that repeat one doc_id (or have none) would all fall in its slot: if that makes the slot HOT times as large as
the mean, such rows are dealt over all slots by a number of their own. The place of a row in its shard is the place of its
slot there plus its rank within the slot, so no window is larger than one slot.

Every version of the map has an entry for every slot, used or not: records that come later always find their shard. An
entry that is missing is an error, never a lost record.

Defined cases: a null text counts 16 bytes and the checksum of the empty text; a null key is hashed like any other;
repeated rows all get places of their own, ties in any order; a very long text counts whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, settle

#: Virtual slots, and bytes that each record counts beside its text.
SLOTS, OVERHEAD = 8192, 16
#: A slot of more than so many times the mean bytes has its repeated keys dealt over all slots.
HOT = 4


def slot_of(key: Column | str, slots: int = SLOTS) -> Column:
    """The virtual slot of a key."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each record; one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of("doc_id", slots).alias("vslot"))


def spread(records: DataFrame, slots: int = SLOTS, hot: float = HOT) -> DataFrame:
    """Settled ``records`` with the rows of hot keys dealt over all slots; a key is hot if it alone makes a slot hot.

    Bytes are summed by slot; only the rows of slots over the bound are summed by key.
    """
    most = (records.agg(F.sum("size")).first()[0] or 0) * hot / slots
    large = records.groupBy("vslot").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > most).select("vslot")
    keys = records.join(F.broadcast(large), "vslot", "left_semi").groupBy("vslot", "doc_id").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"))
    # both broadcasts have fewer rows than slots / hot: each row of them stands for more than ``most`` bytes
    keys = settle(keys.where((F.col("_bytes") > most) & (F.col("_n") > 1)).select(F.col("doc_id").alias("_key"), F.lit(True).alias("_hot")), "hot-keys")
    if not keys.limit(1).count():
        return records
    dealt = records.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("_key")), "left")
    return settle(dealt.withColumn("vslot", F.when(F.col("_hot"), slot_of("_row", slots)).otherwise(F.col("vslot"))).select(records.columns), "spread")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot; those not in use have none."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def _dealt(slots: Column, loads: Column) -> Column:
    """Gives each slot of an array of (bytes, vslot) in turn to the shard of the least load; returns (vslot, shard)."""
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("given"))

    def step(s: Column, x: Column) -> Column:
        to = F.array_position(s["loads"], F.array_min(s["loads"])).cast("int") - 1
        loads_ = F.transform(s["loads"], lambda b, k: F.when(k == to, b + x["bytes"]).otherwise(b))
        return F.struct(loads_.alias("loads"), F.array_append(s["given"], F.struct(x["vslot"].alias("vslot"), to.alias("shard"))).alias("given"))

    # sorted first by slots' bytes, so that large slots come early; an array of at most SLOTS entries in one row
    return F.aggregate(slots, start, step, lambda s: s["given"])


def first_map(loads: DataFrame, shards: int, version: int = 0) -> DataFrame:
    """(version, vslot, shard): the largest slot first, always to the shard of the fewest bytes."""
    order = F.sort_array(F.collect_list(F.struct("bytes", "vslot")), asc=False)
    given = loads.agg(order.alias("slots")).select(F.explode(_dealt(F.col("slots"), F.array_repeat(F.lit(0).cast("long"), shards))).alias("x"))
    return given.select(F.lit(version).alias("version"), "x.vslot", "x.shard")


def rebalance(current: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map for new loads of every slot, or for more shards.

    Each shard keeps its slots, the largest first, as long as they stay within (1 + tolerance) of the mean; the rest,
    with slots not seen before and slots of shards that are gone, go to the shards of the fewest bytes. A slot that the
    loads do not name counts as empty and keeps its entry.
    """
    held = loads.select("vslot", "bytes").join(current.select("vslot", "shard"), "vslot", "full").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("keeps", F.coalesce((F.col("shard") < shards) & (F.sum("bytes").over(own) <= mean * (1 + tolerance)), F.lit(False)))
    kept = F.array_agg(F.when(F.col("keeps"), F.struct("shard", "bytes")))
    loose = F.sort_array(F.array_agg(F.when(~F.col("keeps"), F.struct("bytes", "vslot"))), asc=False)
    one = held.agg(kept.alias("kept"), loose.alias("loose"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.filter("kept", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda s, x: s + x["bytes"]))
    moved = one.select("loose", sums.alias("loads")).select(F.explode(_dealt(F.col("loose"), F.col("loads"))).alias("x")).select("x.vslot", "x.shard")
    both = held.where("keeps").select("vslot", "shard").union(moved)
    latest = current.agg(F.coalesce(F.max("version"), F.lit(-1)).alias("v")).first()["v"]
    return both.select(F.lit(latest + 1).alias("version"), "vslot", "shard")


def write_map(entries: DataFrame, path: str) -> None:
    """Adds one version to the stored map; versions written before stay."""
    entries.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the latest by default."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version").alias("v")).first()["v"]
    return every.where(F.col("version") == version).select("version", "vslot", "shard")


def assign(records: DataFrame, entries: DataFrame, loads: DataFrame) -> DataFrame:
    """``records`` with shard and slot: places from 0 without gaps in each shard, by virtual slot and then by doc_id.

    ``entries`` and ``loads`` have a row for each virtual slot, at most SLOTS. A record whose slot has no entry, or whose
    slot's rows were not counted, is an error.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = entries.select("vslot", "shard").join(loads, "vslot", "left").withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("vslot", "shard", "start", "rows")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    placed = records.withColumn("rank", rank).join(F.broadcast(starts), "vslot", "left")
    wrong = F.raise_error(F.concat(F.lit("no shard, or no count of rows, for slot "), F.col("vslot").cast("string")))
    shard = F.when(F.col("shard").isNotNull() & (F.col("rank") <= F.col("rows")), F.col("shard")).otherwise(wrong.cast("int"))
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("rank", "start", "rows")


def op10_slots(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, over 40 shards."""
    records = spread(settle(sized(documents(spark, sf_dir)), "records"))
    loads = settle(slot_loads(records), "loads")
    entries = settle(first_map(loads, 40), "slot-map")
    out = assign(records, entries, loads)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
