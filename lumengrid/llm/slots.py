"""Shards by fixed virtual slots.

A record's doc_id is hashed to one of some thousands of slots, whose number never changes. Rows and
bytes are added up by slot, and a small map says which shard a slot lies in. Maps are stored by
version: when shards are added or loads drift, the next version edits the last one, moving no more
slots than it has to. A slot that outweighs its neighbours (a doc_id that many rows share, rows
without any) is cut into parts, runs of its rows in order, and the map places its parts.

Only DataFrame functions are used. Texts are read once, for their size and checksum; what is sorted
and joined afterwards are some forty bytes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import numbered, shared_folder, written

#: Fixed for the life of an archive: a row's slot never changes.
SLOTS = 4096
#: A slot of more than a shard's share divided by this is cut into parts.
FINE = 64


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record; all records without doc_id share one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual, n): the virtual slot of each row and its number in order of slots.

    A null text has no bytes, like an empty one; ``size`` is one more than the bytes. Rows that agree
    in all that is looked at are numbered in any order.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("virtual"))
    once = written(rows.withColumn("_salt", F.monotonically_increasing_id()), "slot-rows")
    return numbered(once, ["virtual", "doc_id", "text_crc32", "size", "_salt"], "n").drop("_salt")


def with_parts(rows: DataFrame, shards: int, fine: int = FINE) -> DataFrame:
    """``rows`` with ``part``, 0 but in slots that are too heavy for one entry of the map."""
    by_slot = rows.groupBy("virtual").agg(F.min("n").alias("_first"), F.count("*").alias("_rows"), F.sum("size").alias("_bytes"))
    unit = F.sum("_bytes").over(Window.partitionBy())
    parts = F.ceil(F.col("_bytes") * (shards * fine) / unit).cast("long")
    # one row for each slot at most
    cut = by_slot.select("virtual", "_first", "_rows", parts.alias("_parts"))
    part = F.floor((F.col("n") - F.col("_first")) * F.col("_parts") / F.col("_rows")).cast("int")
    return rows.join(F.broadcast(cut), "virtual").withColumn("part", part).drop("_first", "_rows", "_parts")


def slot_loads(rows: DataFrame) -> DataFrame:
    """(virtual, part, rows, bytes, first): what each entry of the map holds, ``first`` being its first row's number."""
    return rows.groupBy("virtual", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("n").alias("first"))


def next_map(loads: DataFrame, shards: int, previous: DataFrame | None = None, slack: float = 0.01) -> DataFrame:
    """(virtual, part, bytes, shard): the map that follows ``previous``, or the first one.

    Entries stay where they were as long as their shard exists and holds no more than its even share and
    ``slack`` of that, heaviest first. The others are dealt, heaviest first, each to the shard that then
    has least. All of it is a fold over at most a few thousand entries, whatever the rows.
    """
    entries = loads.select("virtual", "part", "bytes")
    share = F.sum("bytes").over(Window.partitionBy()) / shards * (1 + slack)
    if previous is None:
        placed = entries.withColumn("shard", F.lit(None).cast("int"))
    else:
        old = previous.select("virtual", "part", F.col("shard").alias("_was"))
        full = F.sum("bytes").over(Window.partitionBy("_was").orderBy(F.desc("bytes"), "virtual", "part"))
        stays = (F.col("_was") < shards) & (full <= F.col("_share"))
        placed = entries.withColumn("_share", share).join(old, ["virtual", "part"], "left").withColumn("shard", F.when(stays, F.col("_was")))
    entry = F.struct((-F.col("bytes")).alias("minus"), "virtual", "part", "shard")
    all_ = placed.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    kept = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate("entries", F.lit(0).cast("long"), lambda acc, e: acc - F.when(e["shard"] == s, e["minus"]).otherwise(0)))

    def deal(acc: Column, e: Column) -> Column:
        least = F.array_position(acc["held"], F.array_min(acc["held"]))
        held = F.transform(acc["held"], lambda x, i: F.when(i + 1 == least, x - e["minus"]).otherwise(x))
        return F.struct(held.alias("held"), F.array_append(acc["to"], (least - 1).cast("int")).alias("to"))

    moving = F.filter("entries", lambda e: e["shard"].isNull())
    start = F.struct(kept.alias("held"), F.array().cast("array<int>").alias("to"))
    dealt = F.aggregate("moving", start, deal, lambda acc: acc["to"])
    both = all_.withColumn("moving", moving).withColumn("to", dealt)
    new = both.select(F.inline(F.arrays_zip("moving", "to"))).select("moving.*", F.col("to").alias("_to"))
    stay = both.select(F.inline(F.filter("entries", lambda e: e["shard"].isNotNull()))).withColumn("_to", F.col("shard"))
    return new.unionByName(stay).select("virtual", "part", (-F.col("minus")).alias("bytes"), F.col("_to").alias("shard"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store one version; a version that is there is never written over."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the last one unless another is asked for."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version).drop("version")


def placed(rows: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with the shard that the map names and their place in it, from 0 without gaps, in order of slots."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual", "part").rowsBetween(Window.unboundedPreceding, -1))
    # as many rows as the map has, some thousands at most
    heads = loads.join(slot_map.select("virtual", "part", "shard"), ["virtual", "part"]).select("virtual", "part", "first", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    slot = (F.col("_before") + F.col("n") - F.col("first")).cast("long")
    return rows.join(F.broadcast(heads), ["virtual", "part"]).withColumn("slot", slot).drop("_before", "first")


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual, part) for every row of ``docs``, shards of near equal bytes.

    The map is stored as version 1 under ``map_path``, a folder that isn't there yet (one in the shared
    folder unless it is named). Null doc_ids share a slot, repeated rows are placed each, an empty
    table gives an empty result and an empty map; other columns of ``docs`` aren't looked at.
    """
    spark = docs.sparkSession
    rows = written(with_parts(measured(docs, slots), shards), "slot-parts")
    loads = written(slot_loads(rows), "slot-loads")
    path = map_path or f"{shared_folder(spark)}/lumengrid/slot-map-{spark.sql('select uuid()').first()[0]}"
    save_map(next_map(loads, shards), path, 1)
    return placed(rows, loads, load_map(spark, path)).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual", "part")


#: The same by windows and a recursion over the map's entries, for comparison on small tables.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([0,1,2,3,4,5,6,7], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), base AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 4096 AS INT) AS virtual,
         CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
                              lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, crc
), slots AS (
  SELECT *, row_number() OVER (PARTITION BY virtual ORDER BY doc_id, text_crc32, size) - 1 AS k, count(*) OVER (PARTITION BY virtual) AS many,
         ceil(sum(size) OVER (PARTITION BY virtual) * 512.0 / (SELECT sum(size) FROM base)) AS parts
  FROM base
), parted AS (
  SELECT doc_id, size, text_crc32, virtual, k, CAST(floor(k * parts / many) AS INT) AS part FROM slots
), entries AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual, part) AS turn
  FROM (SELECT virtual, part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(k) AS first_k FROM parted GROUP BY virtual, part)
), dealt AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(-1 AS BIGINT) AS shard, CAST([0,0,0,0,0,0,0,0] AS BIGINT[]) AS held
  UNION ALL
  SELECT e.turn, list_position(held, list_min(held)) - 1,
         list_transform(held, lambda x, i: CASE WHEN i = list_position(held, list_min(held)) THEN x + e.bytes ELSE x END)
  FROM dealt d JOIN entries e ON e.turn = d.turn + 1
), heads AS (
  SELECT e.*, d.shard, coalesce(sum(n) OVER (PARTITION BY d.shard ORDER BY virtual, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries e JOIN dealt d ON d.turn = e.turn
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(before + k - first_k AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, virtual, part
FROM parted JOIN heads USING (virtual, part)
"""
