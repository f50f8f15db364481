"""Unified diffs as tables: runs of added lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def added_blocks(diffs: DataFrame, min_lines: int = 1) -> DataFrame:
    """diffs (diff_id, diff) to (diff_id, path, start_line, end_line, text): gaps and islands over the `+` lines.

    A hunk header sets the counter of the new file's lines; added and context lines advance it. One diff is one window
    partition, so it is bounded by a diff's own length.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n", -1)).alias("k", "line"))
    order = Window.partitionBy("diff_id").orderBy("k")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    file = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substr("line", F.lit(5)), "^b/", ""))
    hunk = F.when(F.col("line").startswith("@@"), F.regexp_extract("line", r"\+(\d+)", 1).cast("int"))
    marked = lines.select("*", F.last(file, True).over(so_far).alias("path"), F.last(hunk, True).over(so_far).alias("first"), F.last(F.when(hunk.isNotNull(), F.col("k")), True).over(so_far).alias("at"))
    step = (F.col("line").startswith("+") & ~F.col("line").startswith("+++ ")) | F.col("line").startswith(" ")
    body = marked.where(F.col("at").isNotNull() & (F.col("k") > F.col("at")))
    number = F.sum(step.cast("int")).over(Window.partitionBy("diff_id", "at").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    added = body.withColumn("n", F.col("first") + number - 1).where(F.col("line").startswith("+") & ~F.col("line").startswith("+++ "))
    island = F.col("k") - F.row_number().over(Window.partitionBy("diff_id", "at").orderBy("k"))
    runs = added.withColumn("island", island).groupBy("diff_id", "path", "at", "island").agg(F.min("n").alias("start_line"), F.max("n").alias("end_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substr("line", F.lit(2)).alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    return runs.where(F.col("end_line") - F.col("start_line") + 1 >= min_lines).select("diff_id", "path", "start_line", "end_line", "text")
