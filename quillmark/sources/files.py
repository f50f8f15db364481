"""Trees of files as tables, and their safe reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import any_rlike, glob_regex, ignored, language_of, path_globs

MAX_BYTES = 2_000_000
PROBE = 8192


def guarded(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Files (content, length) of bounded size without a zero byte near their start; the size is judged before the content."""
    return files.where(F.col("length") <= most).where(~F.contains(F.substring("content", 1, PROBE), F.lit(bytearray(b"\0"))))


def tree(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, lang, length, content) of the source files below a folder, ignored folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", f"^.*?{folder.split('://')[-1].rstrip('/')}/", "")
    rows = files.select(path.alias("path"), "length", "content").where(~ignored(F.col("path")) & language_of(F.col("path")).isNotNull())
    if include:
        rows = rows.where(any_rlike(F.col("path"), [r for g in include for r in path_globs(g)]))
    if exclude:
        rows = rows.where(~any_rlike(F.col("path"), [r for g in exclude for r in path_globs(g)]))
    return guarded(rows).select("path", language_of(F.col("path")).alias("lang"), "length", F.col("content").cast("string").alias("content"))


def listing(paths: DataFrame, folder: str = "", recursive: bool = True) -> DataFrame:
    """(kind, path, files): the folders and files below a folder of paths (path), ignored ones left out; files: how many a
    folder holds, at any depth."""
    at = folder.strip("/")
    inner = paths.select("path").where(~ignored(F.col("path")))
    inner = inner.where(F.col("path").startswith(at + "/")).select(F.substr("path", F.lit(len(at) + 2)).alias("path")) if at else inner
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = inner.where(F.size(parts) > 1).select(F.explode(up).alias("path")).groupBy("path").agg(F.count("*").alias("files")).select(F.lit("folder").alias("kind"), "path", "files")
    out = folders.unionByName(inner.select(F.lit("file").alias("kind"), "path", F.lit(1).cast("long").alias("files")))
    return out if recursive else out.where(~F.contains("path", F.lit("/")))


def named(paths: DataFrame, mask: str) -> DataFrame:
    """The paths whose last part the mask matches."""
    return paths.where(F.element_at(F.split("path", "/"), -1).rlike(glob_regex(mask)))


def notes(paths: DataFrame, folder: str = "") -> DataFrame:
    """(name): the notes of a folder: its .md files by their paths from there, without the ending."""
    at = folder.strip("/")
    rows = paths.where(F.endswith("path", F.lit(".md")) & (F.col("path").startswith(at + "/") if at else F.lit(True)))
    return rows.select(F.regexp_replace(F.substr("path", F.lit(len(at) + 2)) if at else F.col("path"), r"\.md$", "").alias("name"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row (revision) of files (path, size, mtime), which changes when a file does, comes or goes. Sums of hashes, so the
    files are in no order and no task holds them all."""
    mark = F.xxhash64("path", "size", "mtime")
    total = F.sum(mark.cast("decimal(20,0)"))
    return files.agg(F.concat_ws("-", F.count("*").cast("string"), F.coalesce(total, F.lit(0)).cast("string"), F.coalesce(F.bit_xor(mark), F.lit(0)).cast("string")).alias("revision"))
