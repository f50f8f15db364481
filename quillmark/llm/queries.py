"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import decontaminate, html_extract, jaccard_join, language_id, line_dedup, mixing, quality_cnn, quality_rules, token_counts, toxicity
from quillmark.llm.common import fold, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.QualityRules.fit(documents, table(spark, sf_dir, "labels")).transform(documents)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.FactorizationMachine.fit(documents, table(spark, sf_dir, "labels")).transform(documents)
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality_cnn.ByteNetwork.fit(documents, table(spark, sf_dir, "labels")).transform(documents)
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= quality_cnn.THRESHOLD).cast("int").alias("predicted"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return out.select("doc_id", lines.alias("n_lines"), F.col("removed").alias("n_removed"), F.length("kept_text").cast("long").alias("n_kept_chars"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.OutputCodes.fit(documents).transform(documents).withColumn("held_out", fold("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "tokens", "topic", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_decontaminate, op3_toxicity, op4_quality_cnn, op5_html_extract, op6_line_dedup, op7_token_counts, op8_language_id, op9_mixing, op10_jaccard_join, pipeline)
    return {f.__name__: f for f in own}


LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
w AS (SELECT doc_id, a, unnest(range(len(a) - 2)) AS p FROM l WHERE len(a) >= 3),
k AS (SELECT doc_id, p, a[p + 1] || chr(10) || a[p + 2] || chr(10) || a[p + 3] AS k FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM k),
c AS (SELECT DISTINCT doc_id, p + o AS pos FROM r, (VALUES (0), (1), (2)) AS t(o) WHERE rn > 1),
e AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM l),
s AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.pos = c.pos WHERE c.pos IS NULL GROUP BY e.doc_id),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT l.doc_id, len(l.a)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, length(coalesce(s.kept, ''))::BIGINT AS n_kept_chars, md5(coalesce(s.kept, '')) AS kept_md5
FROM l LEFT JOIN s ON l.doc_id = s.doc_id LEFT JOIN g ON l.doc_id = g.doc_id
"""


def mixing_sql(sweeps: int = mixing.SWEEPS, fraction: float = mixing.FRACTION) -> str:
    """The raking's steps as one chain of materialised tables."""
    ctes = [
        f"""d AS MATERIALIZED (SELECT doc_id, source, lang, tokens, CASE WHEN tokens < {mixing.BRIEF} THEN 'brief' WHEN tokens < {mixing.LONG} THEN 'article' ELSE 'long' END AS topic
 FROM (SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents))""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t, 1.0::DOUBLE AS w FROM d GROUP BY ALL)",
    ]
    for m in mixing.MARGINS:
        ctes.append(f"s_{m} AS MATERIALIZED (SELECT {m}, pow(sum(t) / (SELECT sum(t) FROM w0), {mixing.TEMPER[m]}) AS s FROM w0 GROUP BY {m})")
        ctes.append(f"t_{m} AS MATERIALIZED (SELECT {m}, s / (SELECT sum(s) FROM s_{m}) * (SELECT sum(t) FROM w0) AS target FROM s_{m})")
    k = 0
    for _ in range(sweeps):
        for m in mixing.MARGINS:
            ctes.append(f"n{k} AS MATERIALIZED (SELECT {m}, sum(t * w) AS now FROM w{k} GROUP BY {m})")
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.t, a.w * b.target / c.now AS w FROM w{k} a JOIN t_{m} b ON a.{m} IS NOT DISTINCT FROM b.{m} JOIN n{k} c ON a.{m} IS NOT DISTINCT FROM c.{m})")
            k += 1
    ctes += [
        f"o AS MATERIALIZED (SELECT *, coalesce(sum(t) OVER (ORDER BY w DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole, sum(t * w) OVER (ORDER BY w DESC, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY w DESC, t) AS k FROM w{k})",
        f"r AS MATERIALIZED (SELECT *, ({fraction} * (SELECT sum(t) FROM w0) - whole) / rest AS r FROM o)",
        "best AS MATERIALIZED (SELECT r FROM r WHERE r * w <= 1 ORDER BY k LIMIT 1)",
        "c AS MATERIALIZED (SELECT source, lang, topic, w, least(1.0, (SELECT r FROM best) * w) AS p FROM o)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT d.doc_id, d.tokens, d.topic, round(c.w, 6) AS weight, round(c.p, 6) AS p,"
        " ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < c.p AS kept"
        " FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic"
    )


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op9_mixing": mixing_sql()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
