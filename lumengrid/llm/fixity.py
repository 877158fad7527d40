"""WARC fixity audit with Merkle trees.

A record's hash is a leaf at its key; 64 neighbouring keys make a node, 64 nodes the next, up
to one root. A node's hash covers the hashes, keys and sizes of what lies under it, so it
speaks for a range of offsets of the ordered archive. Two replicas are compared from the
root down, and only children of nodes that differ are looked at.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

FAN = 64
#: The time that records give where nobody says another, so that equal pages make equal records.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"


def record(key: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A WARC response record without the two line ends that close it; null url and body are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """WARC files of the pages' records, in order of page_id within each file."""
    rows = pages.select(record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"), "page_id")
    rows.sortWithinPartitions("page_id").select("value").write.option("lineSep", END).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            at, rows = 0, []
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            while at < len(data):
                head = data.find(END.encode(), at)
                if head < 0:
                    break
                fields = dict(x.split(": ", 1) for x in data[at:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                size = fields.get("Content-Length", "").strip()
                stop = head + 4 + (int(size) if size.isdigit() else 0)
                rows.append((path, at, stop - at, fields.get("WARC-Record-ID", ""), fields.get("WARC-Target-URI", ""), data[head + 4 : stop]))
                at = stop + 4
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names=["path", "offset", "size", "record_id", "url", "body"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, size, record_id, url, body) of the records of WARC files, plain or gzipped; offsets are those of the
    plain bytes. A file is read whole by one task, so files should be of about a GB, as archives have them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse, "path string, offset long, size long, record_id string, url string, body binary")


def leaves(records: DataFrame) -> DataFrame:
    """(key, hash, bytes) from (key, value): one leaf for each key. Records that share a key are
    combined by sums, in any order, so that no list of them is held. A record whose value is null is there,
    without bytes, and differs from an empty one."""
    held = F.coalesce(F.sha2("value", 256), F.sha2(F.lit("no value"), 256))
    one = records.where("key is not null").select("key", held.alias("h"), (F.coalesce(F.octet_length("value"), F.lit(0)) + len(END)).cast("long").alias("bytes"))
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("long")
    several = F.sha2(F.concat_ws("|", F.min("h"), F.max("h"), F.count("*"), F.bit_xor(number), F.sum(number.cast("decimal(38,0)"))), 256)
    return one.groupBy("key").agg(F.when(F.count("*") == 1, F.min("h")).otherwise(several).alias("hash"), F.sum("bytes").alias("bytes"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: (key, hash, bytes) for each range of 64 keys."""
    kids = F.sort_array(F.collect_list(F.struct("key", "hash", "bytes")))
    named = F.transform(kids, lambda x: F.concat_ws(":", x["key"], x["hash"], x["bytes"]))
    return nodes.groupBy(F.floor(F.col("key") / FAN).cast("long").alias("up")).agg(F.sha2(F.concat_ws("|", named), 256).alias("hash"), F.sum("bytes").alias("bytes")).withColumnRenamed("up", "key")


def build_tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from the leaves up; each is written, and a sixty-fourth of the one below."""
    out = [written(leaves(records), "fixity-leaves")]
    for _ in range(levels):
        out.append(written(parents(out[-1]), "fixity-nodes"))
    return out


def levels_for(low: int, high: int) -> int:
    """How many levels bring keys from low to high under one root."""
    n = 0
    while low != high:
        low, high, n = low // FAN, high // FAN, n + 1
        if (low, high) == (-1, 0):
            break
    return n


def audit(expected: DataFrame, replica: DataFrame) -> DataFrame:
    """(key, fault, offset, bytes, replica_bytes, compared) for each record where the replica differs.

    Both have (key long, value string or binary). ``fault`` is changed, missing or extra; ``offset``
    is where the record starts, or would, in the expected archive ordered by key; ``compared``
    counts the nodes that were looked at on its level. Records without a key are not audited.
    A record whose value is null is a record like others: changed where the replica has bytes. Records
    that share a key are one leaf. Equal replicas, and two empty ones, give no row; other columns of the
    tables are not looked at.
    """
    spark = expected.sparkSession
    keys = expected.select("key").unionByName(replica.select("key")).agg(F.min("key"), F.max("key")).first()
    ddl = "key long, fault string, offset long, bytes long, replica_bytes long, compared long"
    if keys[0] is None:
        return spark.createDataFrame([], ddl)
    levels = levels_for(keys[0], keys[1])
    ours, theirs = build_tree(expected, levels), build_tree(replica, levels)
    open_ = None
    for level in range(levels, -1, -1):
        a = ours[level].select("key", F.col("hash").alias("ours"), "bytes")
        b = theirs[level].select("key", F.col("hash").alias("theirs"), F.col("bytes").alias("replica_bytes"))
        up = F.floor(F.col("key") / FAN).cast("long")
        if open_ is not None:
            wanted = open_.select(F.col("key").alias("up"))
            a, b = (x.withColumn("up", up).join(wanted, "up", "left_semi").drop("up") for x in (a, b))
        both = a.join(b, "key", "full").withColumn("up", up)
        if open_ is not None:
            both = both.join(open_.select(F.col("key").alias("up"), F.col("offset").alias("base")), "up")
        else:
            both = both.withColumn("base", F.lit(0).cast("long")).withColumn("up", F.lit(0))
        before = F.sum(F.coalesce("bytes", F.lit(0))).over(Window.partitionBy("up").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        both = both.withColumn("offset", F.col("base") + F.coalesce(before, F.lit(0)))
        seen = both.select("key", "ours", "theirs", "bytes", "replica_bytes", "offset")
        open_ = written(seen, "fixity-compared")
        compared = open_.count()
        open_ = open_.where(~F.col("ours").eqNullSafe(F.col("theirs")))
    fault = F.when(F.col("ours").isNull(), "extra").when(F.col("theirs").isNull(), "missing").otherwise("changed")
    return open_.select("key", fault.alias("fault"), "offset", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("replica_bytes", F.lit(0)).alias("replica_bytes"), F.lit(compared).cast("long").alias("compared"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: for page_id mod 101 = 7 one character is changed, for 13 of 211
    the end is cut off, for 5 of 307 the record is missing, and for 3 of 401 there is an extra
    one at -1 - page_id."""
    html = F.coalesce("html", F.lit(""))
    i = F.col("page_id")
    hurt = F.when(F.pmod(i, F.lit(101)) == 7, F.overlay(html, F.lit("\u0001"), F.lit(1))).when(F.pmod(i, F.lit(211)) == 13, F.substring(html, 1, 10)).otherwise(html)
    kept = pages.where(~(F.pmod(i, F.lit(307)) == 5)).select(i.alias("key"), record(i, F.col("url"), hurt).alias("value"))
    extra = pages.where(F.pmod(i, F.lit(401)) == 3).select((-1 - i).alias("key"), record(-1 - i, F.col("url"), html).alias("value"))
    return kept.unionByName(extra)


_FIXED = len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Date: \r\nWARC-Target-URI: \r\nContent-Length: ") + len(DATE) + 2 * len(END)

#: What the audit of ``damaged(pages)`` finds, for pages with distinct ids.
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, {_FIXED} AS fixed FROM pages WHERE page_id IS NOT NULL
), q AS (
  SELECT *, CASE WHEN page_id % 101 = 7 THEN chr(1) || substr(html, 2) WHEN page_id % 211 = 13 THEN substr(html, 1, 10) ELSE html END AS hurt FROM p
), r AS (
  SELECT page_id, html, hurt,
         fixed + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS bytes,
         fixed + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(CAST(strlen(hurt) AS VARCHAR)) + strlen(hurt) AS hurt_bytes,
         fixed + strlen(CAST(-1 - page_id AS VARCHAR)) + strlen(url) + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS extra_bytes
  FROM q
), s AS (
  SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r
)
SELECT page_id, CASE WHEN page_id % 307 = 5 THEN 'missing' ELSE 'changed' END AS fault, start AS "offset",
       CAST(bytes AS BIGINT) AS bytes, CAST(CASE WHEN page_id % 307 = 5 THEN 0 ELSE hurt_bytes END AS BIGINT) AS replica_bytes
FROM s WHERE page_id % 307 = 5 OR hurt <> html
UNION ALL
SELECT -1 - page_id, 'extra', 0, 0, CAST(extra_bytes AS BIGINT) FROM r WHERE page_id % 401 = 3
"""
