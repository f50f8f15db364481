"""Line dedup over overlapping three-line windows, in DataFrame operations only.

Every three consecutive lines of a document (split at line feeds, blank lines included) are a window, known by two 64-bit
hashes. One aggregation finds, for each window that occurs twice or more anywhere, its first occurrence by (doc_id,
position). Every other occurrence covers three positions; the covered positions of a document are merged and their lines
removed. No line's content is lost everywhere: its earliest occurrence can't be covered, for the window that covers it would
have an earlier first occurrence.

Plan: windows are exploded as hashes, never as text. The aggregation combines on the map side, so a window that a third of
all documents share is one row of each task; its result is a written table, so the join back to the occurrences has a plain
exchange on both sides and AQE splits a hot window's partition. A document's covered positions are merged as the bits
of 64-bit words, one aggregation by (document, word) and one by document, and each of its lines tests one bit, so the work is in
proportion to the lines. Texts are shuffled once.

Cases: a null text stays null and has no lines; documents of fewer than three lines stay as they are. Null ids sort first
and stand for one document for each text. Rows that agree in id and text get one result each, the same. Extra columns are
carried by `apply`; where one has the name of a result column, the result's gets underscores before it. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, fresh

LINES = 3
#: Marks the second hash.
SEED = "second"
#: Positions of a word of bits, as a power of two.
WORD = 6


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(SEED), text).alias("k2")]


def covered(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, k1, k2, bits): for each document that loses lines, its key and its covered positions as bits of 64-bit words."""
    hashed = F.transform(_lines(F.col(text_col)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(SEED), x).alias("b")))
    docs = documents.where(F.col(text_col).contains("\n")).select(*_keys(id_col, text_col), hashed.alias("h")).where(F.size("h") >= LINES)

    def window(i: Column) -> Column:
        of = [F.get("h", i + k) for k in range(LINES)]
        return F.struct(F.xxhash64(*(x["a"] for x in of)).alias("w1"), F.xxhash64(*(x["b"] for x in of)).alias("w2"))

    windows = docs.select("doc", "k1", "k2", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - LINES), window)).alias("pos", "w")).select("doc", "k1", "k2", "pos", "w.w1", "w.w2")
    place = F.struct("doc", "k1", "k2", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    later = windows.join(cut(first.select("w1", "w2", "first"), "first"), ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    at = F.col("at")
    lines = later.select("doc", "k1", "k2", F.explode(F.array(*(F.col("pos") + k for k in range(LINES)))).alias("at"))
    words = lines.groupBy("doc", "k1", "k2", F.shiftright(at, WORD).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, at & {(1 << WORD) - 1})")).alias("bits"))
    listed = words.groupBy("doc", "k1", "k2").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    none = F.lit(0).cast("long")
    dense = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda x, y: F.concat(F.array(x["bits"]), F.array_repeat(none, F.coalesce(y["word"], x["word"] + 1) - x["word"] - 1)))
    return listed.select("doc", "k1", "k2", F.concat(F.array_repeat(none, F.col("w")[0]["word"]), F.flatten(dense)).alias("bits"))


def apply(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: str = "kept_text", removed: str = "removed") -> DataFrame:
    """documents with two more columns, the last: the text without the covered lines, and the number of lines removed."""
    doc, k1, k2, bits = (fresh(documents, f"__lost_{n}") for n in ("doc", "k1", "k2", "at"))
    result, removed = fresh(documents, result), fresh(documents, removed)
    lost = covered(documents, id_col, text_col).toDF(doc, k1, k2, bits)
    same = documents[id_col].eqNullSafe(lost[doc]) & (F.xxhash64(documents[text_col]) == lost[k1]) & (F.xxhash64(F.lit(SEED), documents[text_col]) == lost[k2])
    text, gone = F.col(text_col), F.col(bits)
    left = F.filter(_lines(text), lambda _, i: F.coalesce(F.bit_get(F.get(gone, F.shiftright(i, WORD)), i.bitwiseAND((1 << WORD) - 1)), F.lit(0)) == 0)
    return (
        documents.join(lost.hint("shuffle_hash"), same, "left")
        .withColumn(result, F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n")))
        .withColumn(removed, F.when(gone.isNull(), 0).otherwise(F.aggregate(gone, F.lit(0), lambda n, x: n + F.bit_count(x))).cast("long"))
        .drop(doc, k1, k2, bits)
    )
