"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a versioned table maps
slots to shards.  Rebalancing edits that table: a slot keeps its shard while the shard has room, else
it moves to the least loaded one.  All of it is DataFrame functions.

The law is ``bytes``: sizes near equal.  Equal texts are not kept together: one text may be a third of all
rows, which no law of equal sizes could hold in one shard.

Edge cases: a null text has size 1 (no bytes, plus 1) and CRC 0; a very long text is one record, and the
lightest shard takes what follows; null ids are hashed as nulls; repeated equal rows get a copy number, so
that they spread over slots; of equally loaded shards the first takes a slot, of equally heavy slots the
first is dealt first; an empty table gives an empty result; columns besides doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, narrow, shared_dir, text_or_empty

#: Virtual slots.  A slot is the unit that moves; it is fixed for the life of a data set.
N_SLOTS = 8192
#: Copies of a row that one task numbers at once.
COPIES = 4096


def size_of(text: str = "text") -> Column:
    return (F.octet_length(text_or_empty(text)) + 1).cast("long")


def slot_of(*keys: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt out in turn."""
    return spark.range(n_slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard")
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes per slot of ``records(virtual_slot, size)``."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def rebalance(current: DataFrame, load: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a slot map.

    Slots are taken from the heaviest to the lightest.  Each stays where it is if its shard then holds
    no more than the mean, and goes to the least loaded shard otherwise.  The state is one array of
    shard loads folded over the slots; the slot count is fixed, so one row holds them all.
    """
    slots = current.join(F.broadcast(load), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    ordered = slots.agg(
        F.max("version").alias("version"),
        F.expr("sort_array(collect_list(struct(-bytes AS heavy, virtual_slot, shard)))").alias("s"),
        F.sum("bytes").alias("total"),
    )
    # the accumulator keeps one type, so the choice is made inside the step
    fold = f"""
      aggregate(s,
        named_struct('load', array_repeat(cast(0 AS bigint), {n_shards}), 'to', cast(array() AS array<int>)),
        (a, x) -> transform(array(
            CASE WHEN x.shard < {n_shards} AND (element_at(a.load, least(x.shard, {n_shards - 1}) + 1) - x.heavy) * {n_shards} <= total THEN x.shard
                 ELSE cast(array_position(a.load, array_min(a.load)) AS int) - 1 END),
            p -> named_struct(
              'load', transform(a.load, (v, i) -> IF(i = p, v - x.heavy, v)),
              'to', concat(a.to, array(p))))[0],
        a -> a.to)"""
    return ordered.select("version", "s", F.expr(fold).alias("to")).select("version", F.expr("explode(arrays_zip(s, to)) AS m")).select(
        (F.col("version") + 1).alias("version"), F.col("m.s.virtual_slot").alias("virtual_slot"), F.col("m.to").alias("shard")
    )


def store_map(version: DataFrame, folder: str, number: int | None = None) -> DataFrame:
    """Adds a version to the map table and returns the whole table as stored.

    A version is a folder of its own, which appears with its commit; a version that is there already (a
    second run) is an error, never added to.  ``number`` saves reading the version's own.
    """
    if number is None:
        version = materialize(version, "slot-map")
        number = version.agg(F.max("version")).first()[0]
    version.select("virtual_slot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={number}")
    return version.sparkSession.read.schema("virtual_slot int, shard int, version int").parquet(folder)


def latest(table: DataFrame) -> DataFrame:
    return table.join(F.broadcast(table.agg(F.max("version").alias("version"))), "version").select("version", "virtual_slot", "shard")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with the shard of their slot; the map has a fixed number of rows, so it is broadcast."""
    return records.join(F.broadcast(slot_map), "virtual_slot")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Each row of ``rows(…, copies)`` that many times, with ``copy`` from 1.

    A row with very many copies is cut into blocks of them, which are dealt out before they are made.
    """
    keys = [c for c in rows.columns if c != "copies"]
    few = rows.filter(F.col("copies") <= COPIES).select(*keys, F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    blocks = rows.filter(F.col("copies") > COPIES).select(*keys, "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("block"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = blocks.repartition(parts, *keys, "block").select(*keys, F.explode(F.expr(f"sequence(block * {COPIES} + 1, least((block + 1) * {COPIES}, copies))")).alias("copy"))
    return few.unionByName(many)


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """Places of all documents: doc_id, size, text_crc32, virtual_slot, map_version, shard, slot.

    ``slot`` numbers a shard's records from 0 without gaps: records are ranked inside their virtual
    slot, and a running sum of slot counts gives each slot's first place.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = narrow(docs, "doc_id", "text").select("doc_id", size_of().alias("size"), F.crc32(text_or_empty()).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = numbered_copies(rows).withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("copy"), n_slots=n_slots))
    table = store_map(initial_map(spark, n_shards, n_slots), folder, 0)
    load = slot_bytes(rows)
    table = store_map(rebalance(latest(table), load, n_shards), folder, 1)
    version = latest(table)
    counts = assign(rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")), version)
    first = counts.select(
        "virtual_slot", "shard", F.col("version").alias("map_version"),
        F.expr("sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"),
    )
    ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, copy)"))
    return ranked.join(F.broadcast(first), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.coalesce("before", F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
