"""Snapshots of the index: keyed overwrite, cascading deletes, change reports. Tables are values; nothing is edited in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def delete(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    return {name: t.join(paths.select("path"), "path", "left_anti") for name, t in tables.items()}


def changes(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, status): added, changed, removed or unchanged, by content hash."""
    a, b = old.select(F.col(key), F.col(digest).alias("was")), new.select(F.col(key), F.col(digest).alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def sync_plan(dirty: DataFrame, deleted: DataFrame, previous: DataFrame) -> DataFrame:
    """(path): all paths to visit: changed, deleted, and those that were dirty before but are not now."""
    now = dirty.select("path").union(deleted.select("path")).distinct()
    return now.union(previous.select("path").subtract(now)).distinct()
