"""A log of events of which each reader is given each finished event once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.shared import exists

#: Newest events that the log offers (a fixed value).
KEEP = 200


def newest(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """The last events by id, keep of them: what a ring of that size would hold."""
    return events.orderBy(F.desc("event_id")).limit(keep)


def marked(spark: SparkSession, folder: str, reader: str) -> int:
    """The last event that a reader was given; -1 before the first."""
    at = f"{folder}/reader={reader}"
    if not exists(spark, at):
        return -1
    return spark.read.schema("seen long, write string").parquet(at).agg(F.max("seen")).first()[0]


def take_unseen(events: DataFrame, folder: str, reader: str, keep: int = KEEP) -> list:
    """The finished events (event_id, finished, ...) of the newest ones that the reader hasn't been given yet, in order; they
    count as given from now on. An event that is still running holds back itself, and the finished ones after it."""
    spark = events.sparkSession
    rows = newest(events, keep).where(F.col("event_id") > marked(spark, folder, reader)).orderBy("event_id").collect()  # keep rows
    given = []
    for r in rows:
        if not r.finished:
            break
        given.append(r)
    if given:
        spark.createDataFrame([(given[-1].event_id, uuid.uuid4().hex)], "seen long, write string").coalesce(1).write.mode("append").parquet(f"{folder}/reader={reader}")
    return given


def notice(events: list) -> str:
    """Events (action, project, failed, detail) as lines for a reader; empty if there are none."""
    if not events:
        return ""
    one = lambda e: f"  - {e.action} on {e.project}{' (FAILED)' if e.failed else ''}{f' - {e.detail}' if e.detail else ''}"
    return "\n".join(["Since the last answer:", *map(one, events), "This is a notice, not a request."])
