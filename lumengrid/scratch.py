"""Tables between steps, in the folder that driver and executors share, and numbers for rows in order."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is set for it if driver and tasks are one
    process (tests, a laptop); on a cluster that is an error, as executors would each write to
    their own disks.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumengrid-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumengrid/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned, once nothing reads them any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            sc = df.sparkSession.sparkContext
            there = sc._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with a long column ``name``: 1, 2, 3 and so on in this order.

    Rows are sorted in ranges by all tasks; only the number of rows of each range meets in a window.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits are the range, the lower ones the place in it
    sorted_ = written(ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # a row for each range, as many as the session has shuffle partitions
    joined = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, (F.col("_start") + place + 1).cast("long")).drop("_at", "_part", "_start")
