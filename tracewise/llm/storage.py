"""Shared-folder storage for intermediate tables.

Executors and driver share only ``spark.checkpoint.dir``; an own folder is chosen where that is unset, as in local tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in a local session without one, a temporary folder that becomes it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: computed once, recoverable without their lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made within delete their shuffle files when they have run. What they give must be collected or written there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mounted(path: str) -> str:
    """The path as open() takes it; memory mapping needs a mounted file system."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{path}: memory-mapped files need spark.checkpoint.dir on a mounted file system")
    return u.path
