"""The corpus model: files, lines, symbols, references and hashed vectors as DataFrames over a table of documents.

A document is a file; it is a symbol of kind `document`, and every five lines of it are one of kind `block`, named by their
first word. A reference is a word that is some block's name. Ids come from the document's id and the block's number, so no
global numbering (and no single task) is needed.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.shared import checkpointed, exists, remove, shared_dir

#: The corpora of this process, by application and folder.
_LOADED: dict[tuple[str, str], Corpus] = {}

BLOCK_LINES = 5
SIGNATURE = 240
#: Ids that a document's symbols may take: more than the blocks of a text of 2 GB.
ID_STEP = 400_000_000
DIM = 64
WORD = r"[\p{L}\p{N}]+"


def _forget(corpus: Corpus) -> None:
    """The index goes when the driver ends."""
    with contextlib.suppress(Exception):
        corpus.drop()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: BM25's column weights (fixed values).
COLUMN_WEIGHTS = {"name": 10.0, "path": 2.0, "body": 1.0}


def hash_slot(token: Column) -> Column:
    """A token's dimension."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(DIM))


def hash_sign(token: Column) -> Column:
    return F.when(F.substring(F.md5(token.cast("binary")), 9, 1) >= "8", -1.0).otherwise(1.0)


def unit_vectors(words: DataFrame) -> DataFrame:
    """(id, dim, x): the hashed unit vectors of counted words (id, term, n), their non-zero parts."""
    raw = words.groupBy("id", hash_slot(F.col("term")).alias("dim")).agg(F.sum(hash_sign(F.col("term")) * F.col("n")).alias("x")).where("x <> 0")
    parts = raw.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p"))  # DIM parts at most
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    return parts.select("id", norm.alias("norm"), F.explode("p").alias("e")).select("id", "e.dim", (F.col("e.x") / F.col("norm")).alias("x"))


def hashed_vectors(bodies: DataFrame) -> DataFrame:
    """The same of texts (id, body). Bodies move once, by id; all groupings keep that partitioning."""
    words = bodies.repartition("id").select("id", F.explode(tokens(F.col("body"))).alias("term"))
    return unit_vectors(words.groupBy("id", "term").agg(F.count("*").alias("n")))


def dense(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of sparse vectors (id, dim, x)."""
    rows = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), "x"))).alias("p"))
    at = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda k: F.coalesce(F.try_element_at("p", k), F.lit(0.0)))
    return rows.select(F.col("id").alias("vec_id"), at.alias("embedding"))


@dataclass
class Corpus:
    """The model's tables. documents: (doc_id, text, lang, source, n_chars)."""

    documents: DataFrame
    #: Where the derived tables are written once and read from; None computes them in each plan.
    folder: str | None = None

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> Corpus:
        """The corpus of a folder of tables, whose index is built once in a session, table by table, at first use."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _LOADED:
            _LOADED[key] = made = cls(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
            atexit.register(_forget, made)
        return _LOADED[key]

    def stored(self, name: str, table: DataFrame) -> DataFrame:
        """The table, written below the folder once. A write that failed half-way left no success mark and is made again."""
        if self.folder is None:
            return table
        at = f"{self.folder}/{name}"
        if not exists(table.sparkSession, f"{at}/_SUCCESS"):
            table.write.mode("overwrite").parquet(at)
        return table.sparkSession.read.schema(table.schema).parquet(at)

    def drop(self) -> None:
        """Forget the corpus and remove its index, after which `load` reads the files as they are then."""
        for key in [k for k, c in _LOADED.items() if c is self]:
            del _LOADED[key]
        if self.folder is not None:
            remove(self.documents.sparkSession, self.folder)

    def build(self) -> Corpus:
        """Make all tables now."""
        _ = self.symbols, self.refs, self.terms, self.vectors, self.postings, self.totals
        return self

    @cached_property
    def docs(self) -> DataFrame:
        path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.documents.select("doc_id", "text", "lang", "n_chars", path.alias("path"))

    @cached_property
    def files(self) -> DataFrame:
        return self.docs.select("path", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("n_chars").alias("size"))

    @cached_property
    def lines(self) -> DataFrame:
        """(doc_id, path, lineno from 1, line)."""
        return self.docs.select("doc_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).select("doc_id", "path", (F.col("k") + 1).alias("lineno"), "line")

    @cached_property
    def symbols(self) -> DataFrame:
        """(id, path, lang, name, kind, start_line, end_line, chars, signature, body)."""
        cut = F.split("text", "\n", -1)
        base = self.docs.select("doc_id", "path", "lang", "text", cut.alias("a"))
        signature = F.substring(F.trim(F.get(F.split("body", "\n", -1), F.lit(0))), 1, SIGNATURE)
        whole = base.select((F.col("doc_id") * ID_STEP).alias("id"), "path", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.lit("document").alias("kind"), F.lit(1).alias("start_line"), F.size("a").alias("end_line"), F.col("text").alias("body"))
        starts = F.sequence(F.lit(0), F.floor((F.size("a") - 1) / BLOCK_LINES).cast("int"))
        parts = base.select("doc_id", "path", "lang", "a", F.explode(starts).alias("k")).select(
            (F.col("doc_id") * ID_STEP + F.col("k") + 1).alias("id"), "path", "lang",
            F.get(tokens(F.get("a", F.col("k") * BLOCK_LINES)), F.lit(0)).alias("name"), F.lit("block").alias("kind"),
            (F.col("k") * BLOCK_LINES + 1).alias("start_line"), F.least(F.size("a"), (F.col("k") + 1) * BLOCK_LINES).alias("end_line"),
            F.array_join(F.slice("a", F.col("k") * BLOCK_LINES + 1, BLOCK_LINES), "\n").alias("body"),
        ).where("name is not null")
        return self.stored("symbols", whole.unionByName(parts).select("id", "path", "lang", "name", "kind", "start_line", "end_line", F.length("body").alias("chars"), signature.alias("signature"), "body"))

    @cached_property
    def heads(self) -> DataFrame:
        """The symbols without bodies."""
        return self.symbols.drop("body", "signature")

    @cached_property
    def uses(self) -> DataFrame:
        """(path, name, line, col): words that are a block's name."""
        return self.refs.drop("owner_id")

    @cached_property
    def refs(self) -> DataFrame:
        """The uses with owner_id: the innermost symbol around them."""
        from quillmark.operators.joins import owner_of

        names = checkpointed(self.heads.where("kind = 'block'").select("name").distinct())  # written, so that a hot word's partition can be split
        words = self.lines.select("path", F.col("lineno").alias("line"), F.posexplode(tokens(F.col("line"))).alias("k", "name")).select("path", "name", "line", (F.col("k") + 1).alias("col"))
        return self.stored("refs", owner_of(words.join(names, "name", "left_semi").select("path", "name", "line", "col"), self.heads))

    @cached_property
    def terms(self) -> DataFrame:
        """(id, block, dl, term, f, n, words): each symbol's distinct words, counted with the columns' weights, in its body, and
        in all; dl: its number of words. Texts are cut into words once, here, and move once, by id."""
        fields = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c == "body").cast("int").alias("b"), tokens(F.col(c)).alias("ts")) for c, w in COLUMN_WEIGHTS.items()])
        rows = self.symbols.select("id", (F.col("kind") == "block").alias("block"), *COLUMN_WEIGHTS).repartition("id").select("id", "block", fields.alias("fields"))
        length = F.aggregate("fields", F.lit(0), lambda n, x: n + F.coalesce(F.size(x["ts"]), F.lit(0)))
        words = rows.select("id", "block", length.alias("dl"), F.inline("fields")).select("id", "block", "dl", "w", "b", F.explode("ts").alias("term"))
        return self.stored("terms", words.groupBy("id", "block", "dl", "term").agg(F.sum("w").alias("f"), F.sum("b").alias("n"), F.count("*").alias("words")))

    @cached_property
    def vectors(self) -> DataFrame:
        """(id, dim, x): the blocks' hashed unit vectors, their non-zero parts. The rows lie in ranges of dim, so a query reads
        its own dimensions only."""
        unit = unit_vectors(self.terms.where("block AND n > 0").select("id", "term", "n"))
        return self.stored("vectors", unit.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id"))

    @cached_property
    def postings(self) -> DataFrame:
        """(term, id, f, n, dl): the words of each symbol, with weighted counts, counts in the body, and the symbol's number of
        words.

        Rows lie in ranges of (term, id): a lookup reads the row groups of its terms, and a frequent term spans several files.
        """
        return self.stored("postings", self.terms.select("term", "id", "f", "n", "dl").repartitionByRange("term", "id").sortWithinPartitions("term", "id"))

    @cached_property
    def totals(self) -> DataFrame:
        """One row (N, avgd, avgc): the number of symbols, and their mean numbers of words and of three-character runs of the body."""
        n = self.symbols.agg(F.count("*").cast("double").alias("N"), F.avg(F.greatest(F.lit(0), F.col("chars") - 2)).alias("avgc"))
        words = self.terms.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("double").alias("words"))
        return self.stored("totals", n.crossJoin(F.broadcast(words)).select("N", (F.col("words") / F.col("N")).alias("avgd"), "avgc"))  # one row each


#: The same tables for the oracle.
SQL = rf"""
d AS (SELECT doc_id, text, lang, n_chars, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS a FROM documents),
files AS (SELECT path, lang, sha256(text) AS hash, n_chars AS size FROM d),
lines AS (SELECT doc_id, path, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS lineno FROM d),
sym0 AS (
 SELECT doc_id * {ID_STEP} AS id, path, lang, 'doc_' || doc_id AS name, 'document' AS kind, 1::BIGINT AS start_line, len(a) AS end_line, text AS body FROM d
 UNION ALL
 SELECT doc_id * {ID_STEP} + k + 1, path, lang, regexp_extract(lower(a[k * {BLOCK_LINES} + 1]), '{WORD}'), 'block', k * {BLOCK_LINES} + 1, least(len(a), (k + 1) * {BLOCK_LINES}), array_to_string(a[k * {BLOCK_LINES} + 1 : (k + 1) * {BLOCK_LINES}], chr(10))
 FROM (SELECT *, unnest(range((len(a) - 1) // {BLOCK_LINES} + 1)) AS k FROM d)),
symbols AS (SELECT id, path, lang, name, kind, start_line, end_line, substr(trim(string_split(body, chr(10))[1], ' '), 1, {SIGNATURE}) AS signature, body FROM sym0 WHERE name <> ''),
names AS (SELECT DISTINCT name FROM symbols WHERE kind = 'block'),
uses AS (SELECT path, name, line, col FROM (SELECT path, lineno AS line, unnest(regexp_extract_all(lower(line), '{WORD}')) AS name, unnest(range(1, len(regexp_extract_all(lower(line), '{WORD}')) + 1)) AS col FROM lines) WHERE name IN (SELECT name FROM names)),
owners AS (SELECT path, line, arg_min(id, (end_line - start_line, -start_line, name)) AS owner_id FROM (SELECT *, unnest(range(start_line, end_line + 1)) AS line FROM symbols) GROUP BY ALL),
refs AS (SELECT u.*, o.owner_id FROM uses u LEFT JOIN owners o ON u.path = o.path AND u.line = o.line),
vec0 AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS dim, sum(CASE WHEN substr(md5(t), 9, 1) >= '8' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS x FROM (SELECT id, unnest(regexp_extract_all(lower(body), '{WORD}')) AS t FROM symbols WHERE kind = 'block') GROUP BY ALL HAVING x <> 0),
vectors AS (SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM vec0)
"""


def with_corpus(select: str, *more: str) -> str:
    return f"WITH {', '.join([SQL.strip(), *(m.strip() for m in more)])} {select}"
