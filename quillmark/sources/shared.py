"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A table that is read only after its write returned needs no success mark.
NO_MARK = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset it is made below the warehouse, which a cluster shares too, or, in
    local mode alone, as in tests, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        at = f"file://{tempfile.mkdtemp(prefix='quillmark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, and the reader knows its size, so that a small
    table is broadcast. It goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    atexit.register(_forget, df.sparkSession, path)
    df.write.option(*NO_MARK).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        remove(spark, path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    at, fs = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)
