"""Change-driven maintenance with Structured Streaming: micro-batch upserts and deletes, and stateful bursts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.shared import children, exists, remove

#: A burst's tools, thresholds and gaps in seconds, and how long a denial silences counting (fixed values).
THRESHOLDS = {"search": 3, "read": 3, "view": 4}
GAPS = {"search": 1000.0, "read": 1000.0, "view": 2000.0}
SILENCE = 120.0
#: Parts of a snapshot by a hash of the key: a batch rewrites those that it touches.
PARTS = 32
#: Files that a micro-batch takes at most.
FILES = 200


def _manifest(spark: SparkSession, snapshots: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest whole epoch (below `before`), and the epoch in which each part was last written."""
    found = [int(x.split("=")[1]) for x in children(spark, f"{snapshots}/manifest") if x.startswith("epoch=") and exists(spark, f"{snapshots}/manifest/{x}/_SUCCESS")]
    found = [e for e in found if before is None or e < before]
    if not found:
        return -1, {}
    return max(found), {r.part: r.epoch for r in spark.read.schema("part int, epoch int").parquet(f"{snapshots}/manifest/epoch={max(found)}").collect()}


def _parts(spark: SparkSession, snapshots: str, at: dict[int, int], schema) -> DataFrame | None:
    paths = [f"{snapshots}/rows/epoch={e}/__part={p}" for p, e in sorted(at.items()) if exists(spark, f"{snapshots}/rows/epoch={e}/__part={p}")]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def stream_upsert(changes: DataFrame, snapshots: str, key: str, version: str, deleted: str | None = None, name: str | None = None, parts: int = PARTS):
    """Start a stream that keeps, for each key, its newest row; a newest row whose `deleted` column is true takes its key out of
    the snapshot, but is kept beside it, so that an older row that comes late doesn't bring the key back.

    A batch rewrites the parts of the snapshot that its keys fall into, in a folder of its own, and then writes a manifest of
    where each part is; only a manifest that is whole counts. A batch that is replayed after a failure writes the same again.
    Parts that no manifest names any more are removed once the next one is whole.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last, at = _manifest(spark, snapshots, epoch)
        dealt = batch.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r[0] for r in dealt.select("__part").distinct().collect()]  # PARTS numbers at most
        old = _parts(spark, snapshots, {p: e for p, e in at.items() if p in touched}, batch.schema)
        rows = batch if old is None else batch.unionByName(old)
        newest = F.max_by(F.struct(*batch.columns), F.struct(version, key)).alias("r")
        merged = rows.groupBy(key).agg(newest).select("r.*").withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        merged.repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{snapshots}/rows/epoch={epoch}")
        now = at | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "part int, epoch int").coalesce(1).write.mode("overwrite").parquet(f"{snapshots}/manifest/epoch={epoch}")
        for e in {e for p, e in at.items() if p in touched}:
            for p in touched:
                if at.get(p) == e and e != epoch:
                    remove(spark, f"{snapshots}/rows/epoch={e}/__part={p}")

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{snapshots}/_progress").trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def newest_snapshot(spark: SparkSession, snapshots: str, schema, deleted: str | None = None) -> DataFrame:
    """The rows of the newest whole snapshot, without deleted ones."""
    _, at = _manifest(spark, snapshots)
    rows = _parts(spark, snapshots, at, schema)
    rows = spark.createDataFrame([], schema) if rows is None else rows
    return rows if deleted is None else rows.where(~F.coalesce(F.col(deleted), F.lit(False)))


def file_changes(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the files that come into a folder, FILES of them a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", FILES).parquet(folder)


def burst_denials(events: DataFrame) -> DataFrame:
    """(user_id, event_id, denied): per user in time order, counters for each tool kind. A counter restarts after its gap; a
    symbolic event clears all; reaching a threshold denies, clears all and silences counting for a while.

    A user's events come in sorted batches, and only the counters are kept between them, so a user of any size fits. The
    state of an event needs that of the one before it, so one user's events are one task's; users are spread over all tasks.
    """
    kind = F.create_map(F.lit("search"), F.lit("search"), F.lit("view"), F.lit("view"), F.lit("click"), F.lit("read"))
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.try_element_at(kind, F.col("event_type")).alias("kind"), (F.col("event_type") == "purchase").alias("symbolic"))
    n = max(8, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "user_id").sortWithinPartitions("user_id", "at", "event_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, counts, last, quiet = object(), {}, {}, 0.0
        for b in batches:
            denied = []
            for u, at, tool, symbolic in zip(*(b[c].tolist() for c in ("user_id", "at", "kind", "symbolic")), strict=True):
                if u != user:
                    user, counts, last, quiet = u, {}, {}, float("-inf")
                no = False
                if symbolic:
                    counts = {}
                elif tool and at >= quiet:
                    if at - last.get(tool, float("-inf")) > GAPS[tool]:
                        counts[tool] = 0
                    counts[tool] = counts.get(tool, 0) + 1
                    last[tool] = at
                    if counts[tool] >= THRESHOLDS[tool]:
                        no, counts, quiet = True, {}, at + SILENCE
                denied.append(no)
            yield pd.DataFrame({"user_id": b.user_id, "event_id": b.event_id, "denied": denied})

    return dealt.mapInPandas(scan, "user_id long, event_id long, denied boolean")
