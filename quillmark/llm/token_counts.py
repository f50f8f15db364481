"""Token counts by a separator scan of flat, unindexed token files.

`write_tokens` encodes whole texts and writes, one file for each task, nothing but token ids: each document's ids and an
end-of-document id. `scan` counts from such files alone. They are read in blocks of BLOCK ids at any place of a file; each
block is searched for the separator with one vectorised comparison; a prefix scan over the blocks' summaries (separators
so far, and where the last one was) stitches documents that cross blocks. One small row a block enters the prefix scan.

Files of a failed task attempt have names of their own and are never listed, so a retried task counts once.

Cases: a null or empty text has 0 tokens. Ids after a file's last separator are a document of their own. Repeated rows each
get a count; null ids are passed through; extra columns are ignored; empty tables give empty results. Special tokens'
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, scratch

#: A tiktoken ranks file; the path is a parameter wherever it is used.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The splitting pattern of those ranks' public tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 20


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    parsed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=parsed, special_tokens={}), len(parsed)


def encoder(path: str = RANKS) -> tuple[bytes, int, str]:
    """A ranks file's content, the free id that separates documents, and the type of an id."""
    with open(path, "rb") as f:
        ranks = f.read()
    n = 1 + max(int(x.split()[1]) for x in ranks.splitlines())
    return ranks, n, "<u2" if n < 1 << 16 else "<u4"


def write_tokens(documents: DataFrame, folder: str, ranks: bytes, separator: int, kind: str) -> DataFrame:
    """Write the flat files below folder. Returns, written, which document is which one of which file: (file, ordinal, doc_id)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, done, enc, out = f"{uuid.uuid4().hex}.ids", 0, None, None
        end = np.array([separator], kind).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                enc, _ = _encoding(ranks)
                out = fs.open_output_stream(f"{base}/{name}")
            for t in b.column(1):
                if text := t.as_py():
                    out.write(enc.encode_to_numpy(text, disallowed_special=()).astype(kind).tobytes())
                out.write(end)
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(np.arange(done, done + b.num_rows)), b.column(0)], names=["file", "ordinal", "doc_id"])
            done += b.num_rows
        if out is not None:
            out.close()

    return cut(documents.select("doc_id", "text").mapInArrow(each, "file string, ordinal long, doc_id long"), "manifest")


def blocks(spark: SparkSession, folder: str, kind: str, block: int = BLOCK) -> DataFrame:
    """(file, block, lo, hi): the id ranges of all blocks of the folder's files; their contents aren't read here."""
    width = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / width).cast("long").alias("n")).where("n > 0")
    return files.select("file", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).alias("block")).select("file", "block", (F.col("block") * block).alias("lo"), F.least("n", (F.col("block") + 1) * block).alias("hi"))


def scan(found: DataFrame, folder: str, separator: int, kind: str) -> DataFrame:
    """(file, ordinal, n_tokens) of each document in the blocks' files."""
    width = np.dtype(kind).itemsize

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    ids = np.frombuffer(f.read_at((r["hi"] - r["lo"]) * width, r["lo"] * width), kind)
                at = np.flatnonzero(ids == separator)
                rows.append((r["file"], r["block"], r["hi"], len(at), r["lo"] + int(at[0]) if len(at) else None, r["lo"] + int(at[-1]) if len(at) else None, (np.diff(at) - 1).tolist()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "hi", "n", "first", "last", "inner"])

    spread = found.repartition(max(8, found.sparkSession.sparkContext.defaultParallelism), "file", "block")
    parts = cut(spread.mapInArrow(each, "file string, block long, hi long, n long, first long, last long, inner array<long>"), "blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the prefix scan runs over the summaries; the blocks' inner lengths rejoin afterwards
    carried = parts.select("file", "block", "hi", "n", "first", "last").select(
        "file", "block", "hi", "n", "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
        F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("closed"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    whole = carried.where("n > 0").join(parts.select("file", "block", "inner"), ["file", "block"])
    lengths = F.concat(F.array(F.col("first") - F.col("carry") - 1), F.col("inner"))
    ended = whole.select("file", "base", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")
    rest = F.col("hi") - F.coalesce("closed", F.lit(-1)) - 1
    opened = carried.where(F.col("final") & (rest > 0)).select("file", (F.col("base") + F.col("n")).alias("ordinal"), rest.alias("n_tokens"))
    return ended.unionByName(opened)


def count_tokens(documents: DataFrame, path: str = RANKS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of each document, counted by the scan of the files that hold the documents' ids."""
    spark = documents.sparkSession
    ranks, separator, kind = encoder(path)
    folder = scratch(spark, "tokens")
    manifest = write_tokens(documents, folder, ranks, separator, kind)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    files = manifest.select("file").distinct()
    counts = scan(blocks(spark, folder, kind, block).join(files, "file", "left_semi"), folder, separator, kind)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
