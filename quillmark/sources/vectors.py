"""Stored vectors: back-fill of missing ones, and staged rebuilds when the embedder changes.

A snapshot is a folder of vectors of one embedder; a pointer table names the snapshot that counts. A back-fill appends to the
snapshot; a rebuild writes a new one and only then moves the pointer, so a failed one leaves the last good vectors in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.embedders import Embedder, embed
from quillmark.sources.shared import exists

VECTORS = "vec_id long, embedding array<float>"


class VectorStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def pointer(self) -> tuple[str, str] | None:
        """The embedder's id and the snapshot that count."""
        if not exists(self.spark, f"{self.folder}/pointer"):
            return None
        best = self.spark.read.schema("version long, embedder string, snapshot string").parquet(f"{self.folder}/pointer").orderBy(F.desc("version")).first()
        return (best.embedder, best.snapshot) if best else None

    def vectors(self) -> DataFrame:
        at = self.pointer()
        if at is None or not exists(self.spark, f"{self.folder}/{at[1]}"):
            return self.spark.createDataFrame([], VECTORS)
        rows = self.spark.read.schema(VECTORS).parquet(f"{self.folder}/{at[1]}")
        return rows

    def any(self) -> bool:
        """Whether there is a vector at all."""
        return not self.vectors().isEmpty()

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows (id, text) that have no vector yet; blank texts never get one."""
        return rows.where(F.col("text").rlike(r"\S")).join(self.vectors().select(F.col("vec_id").alias("id")), "id", "left_anti")

    def backfill(self, rows: DataFrame, by: Embedder, explicit: bool = True) -> str:
        """Embed what is missing; returns what was done: rebuilt, kept or filled.

        Another embedder's vectors are all made anew. But a hashing embedder that nobody asked for (not explicit), because a
        model failed to load, never takes the place of a model's vectors.
        """
        at = self.pointer()
        if at is None or at[0] != by.id:
            if at is not None and not explicit and by.id.startswith("hashing-") and not at[0].startswith("hashing-"):
                return "kept"
            snapshot = f"vectors-{uuid.uuid4().hex}"
            embed(rows.where(F.col("text").rlike(r"\S")), by).write.parquet(f"{self.folder}/{snapshot}")
            version = 0 if at is None else 1 + self.spark.read.parquet(f"{self.folder}/pointer").agg(F.max("version")).first()[0]
            self.spark.createDataFrame([(version, by.id, snapshot)], "version long, embedder string, snapshot string").coalesce(1).write.mode("append").parquet(f"{self.folder}/pointer")
            return "rebuilt"
        embed(self.missing(rows), by).write.mode("append").parquet(f"{self.folder}/{at[1]}")
        return "filled"
