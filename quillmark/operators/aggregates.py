"""Aggregations of the tool surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(column, share): each value's percentage of the rows, to 2 places."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(column, F.round(100.0 * F.col("n") / F.col("total"), 2).alias("share"))  # one row


def usage(calls: DataFrame, tool: str, given: str, returned: str) -> DataFrame:
    """Per tool: calls, and the estimated tokens (a quarter of the characters) given and returned."""
    est = lambda c: F.floor(F.length(c) / 4)
    return calls.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), F.sum(est(given)).alias("input_tokens"), F.sum(est(returned)).alias("output_tokens"))


def latest(rows: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """The value of each key's last version."""
    return rows.groupBy(key).agg(F.max_by(value, version).alias(value))


def bursts(events: DataFrame, key: str, gap: float, resets) -> DataFrame:
    """events with the count since the last gap or reset, by key and time; ties by event id."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    since = at - F.lag(at).over(order)
    new = (since.isNull() | (since > gap) | resets).cast("int")
    marked = events.withColumn("run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("burst", F.row_number().over(Window.partitionBy(key, "run").orderBy("ts", "event_id")))


def composition(files: DataFrame, masks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(lang, share): the percentage of all files whose name ends in one of a language's endings, whatever its case, to 2
    places. A file may count for several languages; languages without files are left out."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    hit = lambda ends: F.when(F.exists(F.array(*[F.endswith(name, F.lit(e)) for e in ends]), lambda x: x), True)
    langs = F.array_compact(F.array(*[F.when(hit(ends), F.lit(lang)) for lang, ends in sorted(masks.items())]))
    total = files.agg(F.count("*").alias("total"))
    counted = files.select(F.explode(langs).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("lang", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("share"))  # one row


def significant(shares_: DataFrame, languages: list[str], least: float = 10.0, most: int = 4) -> DataFrame:
    """The programming languages with a share of least or more, the largest first, most of them at most."""
    return shares_.where(F.col("lang").isin(*languages) & (F.col("share") >= least)).orderBy(F.desc("share"), "lang").limit(most)


def by_severity(diagnostics: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(path, s1.., problems): counts by severity, and the file's diagnostics in order of line, severity and message."""
    counts = [F.count_if(F.col("severity") == k).alias(f"s{k}") for k in levels]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "severity", "message"))), lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["severity"].cast("string"), F.lit(":"), x["message"]))
    return diagnostics.groupBy("path").agg(*counts, listed.alias("problems"))


def nested(rows: DataFrame, keys: list[str], item: str, collapse: bool = True) -> DataFrame:
    """One row (grouped): JSON of rows grouped by the keys, one within the other, in order of the keys; the items of a group in
    their own order. Missing keys are `unknown`. collapse: an item that is a struct of one field is that field's value."""
    value = F.col(item)
    kind = rows.schema[item].dataType
    if collapse and hasattr(kind, "fields") and len(kind.fields) == 1:
        value = value[kind.fields[0].name]
    now = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys], value.alias("grouped"))
    out = F.to_json(F.array_sort(F.collect_list("grouped")))
    for k in range(len(keys), -1, -1):
        now = now.groupBy(*keys[:k]).agg(out.alias("grouped"))
        if k:
            quoted = F.to_json(F.array(F.col(keys[k - 1])))  # ["key"]
            entry = F.concat(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.col("grouped"))
            now = now.withColumn("grouped", F.struct(F.col(keys[k - 1]).alias("k"), entry.alias("e")))
            out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("grouped")), lambda x: x["e"]), ","), F.lit("}"))
    return now


def health(symbols: DataFrame, vectors: DataFrame, embedder: str = "", dirty: int = 0, moved: bool = False) -> DataFrame:
    """One row (symbols, vectors, missing, semantic, advice): what an index can answer, and what to do about the rest.

    symbols: (id); vectors: (id). semantic: vectors of a model are there; hashed ones match words only.
    """
    both = symbols.select("id", F.lit(1).alias("s")).join(vectors.select("id", F.lit(1).alias("v")), "id", "full")
    n = both.agg(F.count("s").alias("symbols"), F.count("v").alias("vectors"), F.count_if(F.col("s").isNotNull() & F.col("v").isNull()).alias("missing"))
    hashed = F.lit(embedder.startswith(("hashing-", "digest-")))
    advice = F.array(F.when(F.col("vectors") == 0, "embed"), F.when((F.col("vectors") > 0) & hashed, "hashed"), F.when(F.col("missing") > 0, "backfill"), F.when(F.lit(dirty > 0), "sync"), F.when(F.lit(moved), "head"))
    return n.select("symbols", "vectors", "missing", ((F.col("vectors") > 0) & ~hashed).alias("semantic"), F.array_join(F.array_compact(advice), ",").alias("advice"))
