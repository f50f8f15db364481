"""A training corpus from `documents`, in five stages. Each stage's rows are written as Parquet and read again.

Cases: null, empty and blank texts have no words, so the first stage rejects them; the later ones would keep them as they are. A
null language or source is a value of its own in the mixing. Rows with a null id are joined with nothing, so they stay, and
are sampled by the text `null`. Rows that repeat an id and a text go through together until the join keeps one of them; of an
id with several texts each is kept or dropped by itself. Extra columns are carried, whatever their names; those that the last
stage adds get underscores before them where a name is taken. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, jaccard_join, line_dedup, mixing
from quillmark.llm.common import cut, fresh, table
from quillmark.llm.quality_rules import QualityRules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the model rejects go. The model learns from the labels of the documents given."""
    return QualityRules.fit(docs, table(spark, sf_dir, "labels")).filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows lose their lines; a document that had words and keeps none goes."""
    text, gone = fresh(docs, "__text"), fresh(docs, "__gone")
    out = line_dedup.apply(docs, result=text, removed=gone).where((F.col(gone) == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col(gone) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": F.col(text), "n_chars": length}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each class of near copies stays."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents with their tokens, raked weights and numbers of copies; tokens * copies meet the targets."""
    return mixing.draw(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("mixing", mix_sources)]

#: The first stage's model and the join's sets can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
