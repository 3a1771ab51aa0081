"""Edges as they arrive: parsing a stream of text lines, and enabled labels kept up to date by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.sources.lts import LARGEST, _parsed


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, name) of text files that appear in a folder; lines that are no edges are left out."""
    lines = spark.readStream.format("text").load(folder).select("value", F.lit(0).cast("bigint").alias("line"))
    return _parsed(lines, LARGEST).where("fields = 3 AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "name")


def enabled_labels(edges: DataFrame) -> DataFrame:
    """(pid, enabled): the labels seen so far of each state; for output mode complete or update."""
    return edges.groupBy(F.col("src").alias("pid")).agg(F.sort_array(F.collect_set("name")).alias("enabled"))
