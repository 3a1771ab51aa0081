"""Iteration over DataFrames: each round is cut from its lineage by a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in a local session without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="rounds-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, split: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once and read back from the shared folder, so that a lost executor loses no round.

    ``rows`` of the result tells how many there are; with ``split``, a boolean column that the table is split by, those in which it
    holds, and ``all_rows`` all."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    seen = Observation()
    every = F.count(F.lit(1))
    writer = df.observe(seen, every.alias("all_rows"), (every if split is None else F.count_if(F.col(split))).alias("rows")).write
    (writer if split is None else writer.partitionBy(split)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path, out.rows, out.all_rows = path, seen.get["rows"], seen.get["all_rows"]
    return out


#: Rows of a shuffle partition, about, where their number is known, and the bytes to which small ones are merged then.
DEALT, MERGED = 500_000, 16 << 20


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans run within shuffle ``rows`` rows in as many partitions as keep a task's share at about DEALT, so that the memory of a task does not
    grow with the input; never in fewer than the session's."""
    parts, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, size = spark.conf.get(parts), spark.conf.get(merged, None)
    want = -(-rows // DEALT)
    if want <= int(before):
        yield
        return
    spark.conf.set(parts, str(want))
    if size is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size) > MERGED:
        spark.conf.set(merged, f"{MERGED}b")
    try:
        yield
    finally:
        spark.conf.set(parts, before)
        if size is None:
            spark.conf.unset(merged)
        else:
            spark.conf.set(merged, size)


def dealt_by(df: DataFrame, rows: int | None, key: str, always: bool = False) -> DataFrame:
    """``df`` dealt by ``key`` in partitions of about DEALT of ``rows``, for plans that run later, where that is more than the session's number;
    else as it is or, if ``always``, dealt in that number."""
    want = -(-(rows or 0) // DEALT)
    if want > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(want, key)
    return df.repartition(key) if always else df


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of ``cut`` frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of the column ``by``: numbers within ranges, and a count before each range.

    The counts are a row for each shuffle partition, which bounds what is broadcast."""
    split = cut(df.repartitionByRange(by).withColumn("range_id", F.spark_partition_id()))
    sizes = split.groupBy("range_id").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("range_id", F.coalesce(before, F.lit(0)).alias("rows_before"))
    place = F.row_number().over(Window.partitionBy("range_id").orderBy(by))
    numbered = split.withColumn(name, place.cast("bigint") - 1).join(F.broadcast(sizes), "range_id")
    return numbered.withColumn(name, F.col(name) + F.col("rows_before")).drop("range_id", "rows_before")


def followed(df: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """``df`` with a struct ``name`` of the ``columns`` of the next row in the order of ``by`` (then of ``columns``), null for the last row: the next
    one within ranges, and for the last row of a range the first of the next range, a row for each shuffle partition."""
    split = cut(df.repartitionByRange(*by).withColumn("range_id", F.spark_partition_id()))
    first = F.min(F.struct(F.struct(*by).alias("by"), F.struct(*columns).alias("row")))["row"]
    heads = split.groupBy("range_id").agg(first.alias("head"))
    heads = heads.select("range_id", F.lead("head").over(Window.orderBy("range_id")).alias("next_head"))
    within = F.lead(F.struct(*columns)).over(Window.partitionBy("range_id").orderBy(*by, *columns))
    near = split.withColumn(name, within).join(F.broadcast(heads), "range_id")
    return near.withColumn(name, F.coalesce(name, "next_head")).drop("range_id", "next_head")


#: Rows of a partition that are held as a hash table in a join, at most: tables with one row for each key.
HELD = 1_000_000

#: Keys with more rows than one in this many are hot, so there are at most this many of them.
HOT = 100_000


def hot_keys(df: DataFrame, key: str, least: int = 10_000) -> DataFrame:
    """(key) of the keys that hold more than one in HOT of all rows, and at least ``least``: at most HOT keys, which may be broadcast."""
    rows = vars(df).get("rows")  # as ``cut`` has counted
    rows = df.count() if rows is None else rows
    if rows <= least:
        none = df.sparkSession.createDataFrame([], df.select(key).schema)
        none.rows = 0
        return none
    return cut(df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > max(least, rows // HOT)).select(key))


def skew_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``many`` joined with ``one`` (at most one row for each key). Rows of ``hot`` keys stay where they are and meet their few partners by
    broadcast; the rest is shuffled by key."""
    few = F.broadcast(hot)
    rest = many.join(few, key, "left_anti").join(one, key)
    return rest.unionByName(many.join(few, key, "left_semi").join(F.broadcast(one.join(few, key, "left_semi")), key))
