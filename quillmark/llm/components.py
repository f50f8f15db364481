"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames.

Every step is an aggregation with a map-side combine and an equi-join of written tables, which may be split where a vertex is
hot, and each step's edges are written to the shared folder. Rounds grow with the logarithm of a component's diameter; nothing is
collected but the counts that end the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex of edges (a, b) and the least vertex of its component."""
    return counted_components(edges)[0]


def counted_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """The same, and a bound of its rows."""
    now, before = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "edges"), None
    while True:
        # done when a round changes nothing, or there is nothing
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        n = state[0]
        if state == before or not n:
            return now.select("v", F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct()), 2 * n
        before = state
        # large star: v's larger neighbours get its least neighbour
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = cut(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "least", 2 * n)
        large = cut(both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct(), "large", n)
        # small star: v and its smaller neighbours get the least of them
        low = cut(large.groupBy("v").agg(F.min("u").alias("m")), "low", n)
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        now = cut(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "edges", n)
