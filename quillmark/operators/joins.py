"""Joins of the model: containment by line, hydration, set differences of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import checkpointed


def owner_of(points: DataFrame, symbols: DataFrame, line: str = "line", order: list[Column] | None = None) -> DataFrame:
    """points with owner_id, the innermost symbol whose lines hold the point, null if none.

    Symbols are spread over their lines, so the join is an equi-join on path and line instead of a range join; a file's rows
    meet only at their own lines. Ties: the shorter, then the later start, then the name.
    """
    order = order or [F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("name")]
    spread = symbols.select("path", "id", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), F.explode(F.sequence("start_line", "end_line")).alias(line))
    best = spread.groupBy("path", line).agg(F.min_by("id", "o").alias("owner_id"))
    return points.join(best, ["path", line], "left").select(*points.columns, "owner_id")


def hydrate(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """hits (id, ...) with their symbols and file languages; bodies may be missing."""
    return hits.join(symbols, "id").join(files.select("path", F.col("lang").alias("file_lang")), "path")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key the others don't have."""
    return rows.join(others.select(key), key, "left_anti")


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct rows of after that before doesn't have; nulls equal nulls."""
    a, b = after.distinct(), before.distinct().toDF(*(f"_b_{c}" for c in before.columns))
    same = [a[c].eqNullSafe(b[f"_b_{c}"]) for c in after.columns]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return a.join(b, on, "left_anti")


def climb(start: DataFrame, parents: DataFrame, low: Column) -> DataFrame:
    """(key, id): each start's nearest ancestor, itself included, for which low is false; the last one if low is true for all.

    parents: (id, parent_id, ...). One join a level; the rows that don't move any more leave the loop, so it ends with the
    deepest chain. A chain that leads back to itself is an error.
    """
    done, now = None, start.select("key", "id", F.array("id").alias("trail"))
    while True:
        at = checkpointed(now.join(parents, "id", "left").withColumn("up", F.coalesce(low, F.lit(False)) & F.col("parent_id").isNotNull()))
        still = at.where("not up").select("key", "id")
        done = still if done is None else done.unionByName(still)
        moved = at.where("up")
        if moved.isEmpty():
            return done
        if not moved.where(F.array_contains("trail", F.col("parent_id"))).isEmpty():
            raise ValueError("a symbol is its own ancestor")
        now = moved.select("key", F.col("parent_id").alias("id"), F.concat("trail", F.array("parent_id")).alias("trail"))
