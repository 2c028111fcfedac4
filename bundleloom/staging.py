"""Tables written once in the cluster's shared folder and read back: cuts lineage, survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (tests, one machine) gets a folder of its own; a cluster is refused, since
    each executor would write to its own disk.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bundleloom-stage-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table through Hadoop's file system, so any store works."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _live.pop(path, None)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The files go when they are unstaged, at :func:`release`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def track(spark: SparkSession, path: str) -> str:
    """Have a path removed with the staged tables, at the latest when the driver's Python ends."""
    _live[path] = spark
    return path


def is_staged(df: DataFrame) -> bool:
    return hasattr(df, "_staged_at")


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that no later result reads."""
    for df in frames:
        drop_path(df.sparkSession, df._staged_at)


@contextlib.contextmanager
def scope():
    """Tables staged inside go at its end."""
    before = set(_live)
    try:
        yield
    finally:
        for path in set(_live) - before:
            drop_path(_live[path], path)


def release() -> None:
    """Remove all staged tables: for long sessions, once the results that read them are written."""
    for path, spark in list(_live.items()):
        if spark.sparkContext._jsc is not None:
            drop_path(spark, path)


atexit.register(release)
