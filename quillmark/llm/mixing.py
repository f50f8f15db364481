"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Tokens (words) are summed by cell of source, language and topic. Raking multiplies the cells' weights, margin after margin,
until each margin's weighted tokens meet its target. The rate r solves  sum T * min(1, r * w) = FRACTION * sum T,  and a
document of a cell with weight w is kept with probability p = min(1, r * w), by a hash of its id: the same documents at
any partitioning. Documents kept at most once can't meet the targets of scarce cells (r * w > 1): `mix` and its `kept` miss
the margins there. `draw` meets them: a document stands for FRACTION * w copies, the whole part of that for sure and one more
with the probability of the rest, so the expected tokens * copies of each margin are FRACTION times its target.

`documents` has no topic column, so the queries use the form of a text as its topic: brief, article or long by its words
(see `form`); any column or expression can take its place.

Cells are few (sources x languages x topics). Up to MAX_CELLS are raked on the driver and broadcast, a checked bound; beyond
it the same steps run as DataFrames with written intermediate tables, and give the same weights and probabilities.

Cases: null sources, languages or topics are cells of their own. Null and empty texts have no tokens and topic brief; a cell
without tokens gets weight 1. A null id is hashed as the text `null`. Repeated rows are kept or dropped together. Extra
columns are carried. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import cut, fresh

MARGINS = ("source", "lang", "topic")
#: A margin's targets are its shares to this power: 1 keeps the shares, 0 makes all equal.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.0}
SWEEPS = 8
FRACTION = 0.5
MAX_CELLS = 100_000
BRIEF, LONG = 100, 600


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form(n: Column) -> Column:
    return F.when(n < BRIEF, "brief").when(n < LONG, "article").otherwise("long")


def uniform(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def rake(keys: list[tuple], tokens: np.ndarray, temper: dict = TEMPER, sweeps: int = SWEEPS) -> np.ndarray:
    """The cells' weights. keys: each cell's value in each margin."""
    w, total = np.ones(len(tokens)), tokens.sum()
    if total == 0:
        return w
    margins = []
    for j, m in enumerate(MARGINS):
        names: dict = {}
        at = np.array([names.setdefault(k[j], len(names)) for k in keys])
        share = np.bincount(at, weights=tokens) / total
        target = np.where(share > 0, share ** temper[m], 0)
        margins.append((at, target / target.sum() * total))
    for _ in range(sweeps):
        for at, target in margins:
            now = np.bincount(at, weights=tokens * w)
            w = w * np.where(now > 0, target / np.where(now > 0, now, 1), 1)[at]
    return w


def rate(tokens: np.ndarray, w: np.ndarray, fraction: float = FRACTION) -> float:
    """r with sum tokens * min(1, r * w) = fraction * sum tokens: the cells of the largest weights are kept whole."""
    order = np.lexsort((tokens, -w))
    t, w = tokens[order], w[order]
    whole = np.concatenate([[0], np.cumsum(t)[:-1]])
    rest = np.cumsum((t * w)[::-1])[::-1]
    r = (fraction * t.sum() - whole) / np.where(rest > 0, rest, 1)
    fits = np.flatnonzero((r * w <= 1) & (rest > 0))
    return float(r[fits[0]]) if len(fits) else 1.0


def cell_weights(cells: DataFrame, temper: dict = TEMPER, sweeps: int = SWEEPS, fraction: float = FRACTION, max_cells: int = MAX_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight and probability p."""
    spark = cells.sparkSession
    got = sorted(cells.limit(max_cells + 1).collect(), key=lambda r: [(x is not None, x or "") for x in r[:3]])
    if len(got) > max_cells:
        return _frames(cells, temper, sweeps, fraction)
    tokens = np.array([r.tokens for r in got], float)
    w = rake([tuple(r)[:3] for r in got], tokens, temper, sweeps)
    p = np.minimum(1, rate(tokens, w, fraction) * w) if len(got) else w
    return _small(spark, [(*r, float(a), float(b)) for r, a, b in zip(got, w, p, strict=True)])


def _small(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double, p double"))


def _frames(cells: DataFrame, temper: dict, sweeps: int, fraction: float) -> DataFrame:
    """The same for any number of cells: each margin's step is an aggregation and a join, and each sweep is written."""
    cells = cut(cells.withColumn("weight", F.lit(1.0)))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    targets = {}
    for m in MARGINS:
        share = cells.groupBy(m).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("s")).withColumn("t", F.when(F.col("s") > 0, F.pow("s", F.lit(float(temper[m])))).otherwise(0.0))
        targets[m] = cut(share.crossJoin(F.broadcast(share.agg(F.sum("t").alias("all")))).select(F.col(m).alias("name"), (F.col("t") / F.col("all") * float(total)).alias("target")))
    for _ in range(sweeps if total else 0):
        for m in MARGINS:
            now = cells.groupBy(F.col(m).alias("name")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = now.join(targets[m].withColumnRenamed("name", "of"), F.col("name").eqNullSafe(F.col("of"))).select("name", F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(1.0).alias("factor"))
            cells = cells.join(factor, F.col(m).eqNullSafe(F.col("name"))).select(*MARGINS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
        cells = cut(cells)
    # the rate: cells of r * w > 1 are kept whole and r is solved for the others, until no other cell passes 1
    r, whole = 0.0, -1
    while total:
        over = F.col("weight") * r > 1
        n, kept, rest = cells.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("tokens")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if n == whole or not rest:
            break
        r, whole = (fraction * total - kept) / rest, n
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("weight") * F.lit(float(r if total and r else 1.0))))


def mix(documents: DataFrame, topic: Column | None = None, **settings) -> DataFrame:
    """documents with tokens, topic, weight, p and kept, under the names that `names` gives."""
    n = names(documents)
    docs = documents.withColumn(n["tokens"], words())
    docs = docs.withColumn(n["topic"], form(F.col(n["tokens"])) if topic is None else topic)
    keys = [F.col("source").alias("source"), F.col("lang").alias("lang"), F.col(n["topic"]).alias("topic")]
    cells = docs.groupBy(*keys).agg(F.sum(n["tokens"]).alias("tokens"))
    own = [fresh(documents, f"__{x}") for x in MARGINS]
    got = cell_weights(cells, **settings).select(*(F.col(m).alias(o) for m, o in zip(MARGINS, own, strict=True)), F.col("weight").alias(n["weight"]), F.col("p").alias(n["p"]))
    same = docs["source"].eqNullSafe(got[own[0]]) & docs["lang"].eqNullSafe(got[own[1]]) & docs[n["topic"]].eqNullSafe(got[own[2]])
    return docs.join(got, same).drop(*own).withColumn(n["kept"], uniform() < F.col(n["p"]))


def draw(documents: DataFrame, topic: Column | None = None, fraction: float = FRACTION, **settings) -> DataFrame:
    """The documents with at least one copy, once each, with tokens, topic, weight and their number of copies."""
    n, copies = names(documents), fresh(documents, "copies")
    mean = F.col(n["weight"]) * F.lit(float(fraction))
    out = mix(documents, topic, fraction=fraction, **settings).drop(n["p"], n["kept"])
    return out.withColumn(copies, (F.floor(mean) + (uniform() < mean - F.floor(mean)).cast("long")).cast("long")).where(F.col(copies) > 0)


def names(documents: DataFrame) -> dict[str, str]:
    return {x: fresh(documents, x) for x in ("tokens", "topic", "weight", "p", "kept")}
