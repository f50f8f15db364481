"""What the operators share: tables, names, written intermediate tables, and bounded training samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a class may give to a training sample.
PER_CLASS = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set it is made below the warehouse, which a cluster
    shares too, or, in local mode alone, as in tests, in a temporary folder."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        at = f"file://{tempfile.mkdtemp(prefix='quillmark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name below the shared one; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quillmark/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: A table that is read only after its write returned needs no success mark, which would be a file more for the driver to make.
NO_MARK = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")


def made(path: str) -> str:
    """path, with the folders that a write makes in it first, if it is a local one. For each folder that Hadoop makes itself there
    it starts a `chmod`, a child that shares the driver's whole memory for a moment."""
    if path.startswith("file:"):
        os.makedirs(f"{urlsplit(path).path}/_temporary/0/_temporary", exist_ok=True)
    return path


#: Rows of a written table that a file takes at least, where their number is known.
ROWS_A_FILE = 50_000


def cut(df: DataFrame, kind: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors lose nothing.

    rows: about how many there are, where that is known: a small table then takes few tasks and files, as many as it needs.
    """
    path = made(scratch(df.sparkSession, kind))
    (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.mode("append").option(*NO_MARK).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def stratified(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """A sample with about per_class rows of each class at most, by a hash of the id, and the rows that each class has in all.

    The sample depends on ids alone, not on partitions. Null classes give none. The classes are those that a model holds weights
    for, so their counts fit the driver and a broadcast; there may be any number of them.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count().collect()}
    most = fresh(rows, "__most")
    limits = [(k, int(min(1.0, per_class / n) * (1 << 40))) for k, n in sorted(counts.items(), key=str)]
    kind = dict(rows.dtypes)[class_col]
    of = rows.sparkSession.createDataFrame(limits, f"{fresh(rows, '__class')} {kind}, {most} long")
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 40))
    return rows.join(F.broadcast(of), rows[class_col] == of[of.columns[0]]).where(u < F.col(most)).select(*rows.columns), counts


def labelled(documents: DataFrame, labels: DataFrame, label: str, held_out: Column | None, per_class: int = PER_CLASS) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of a bounded, class-balanced sample of the labelled documents outside the held-out fold.

    An id that is labelled twice counts with its largest label, and an id with several texts with the least of them.
    The labels' side of the join has at most about per_class rows for each class, so it is broadcast.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample, counts = stratified(rows, "doc_id", "label", per_class)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return joined, counts


def tidy() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds what its last one took otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df, batch by batch, through f."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield f(b)
        tidy()

    return df.mapInArrow(each, schema)


def arrow_filter(df: DataFrame, text_col: str, keep: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of df whose text's flag is true, with all their columns, whatever these are called."""
    at = df.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(keep(b.column(at)))
        tidy()

    return df.mapInArrow(each, df.schema)
