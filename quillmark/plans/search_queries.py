"""Queries of ranked retrieval and of the model's scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import retrieval as R
from quillmark.operators.joins import hydrate, missing
from quillmark.plans.corpus import DIM, Corpus, with_corpus
from quillmark.plans.registry import query

QUERY = "the and that"
LIMIT = 10

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(terms: list[str], where: str = "TRUE", name: str = "bm25") -> str:
    cols = {"name": 10, "path": 2, "body": 1}
    f = [" + ".join(f"{w}.0::DOUBLE * len(list_filter(t_{c}, lambda x: x = '{t}'))" for c, w in cols.items()) for t in terms]
    score = " + ".join(f"CASE WHEN f{k} > 0 THEN greatest(ln((N - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgd)) ELSE 0 END" for k in range(len(terms)))
    return f"""
{name}_t AS (SELECT id, path, lang, kind, {", ".join(f"{TOKENS.format(c)} AS t_{c}" for c in cols)} FROM symbols),
{name}_f AS (SELECT id, path, lang, kind, len(t_name) + len(t_path) + len(t_body) AS dl, {", ".join(f"{x} AS f{k}" for k, x in enumerate(f))} FROM {name}_t),
{name}_s AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS avgd, {", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1.0::DOUBLE ELSE 0 END) AS n{k}" for k in range(len(terms)))} FROM {name}_f),
{name} AS (SELECT id, round({score}, 6) AS score FROM {name}_f, {name}_s WHERE ({" OR ".join(f"f{k} > 0" for k in range(len(terms)))}) AND {where})"""


def _name_sql(query_: str, where: str = "TRUE") -> str:
    terms = [t for t in R.query_terms(query_) if len(t) >= 3]
    covered = " + ".join(f"contains(lower(name), '{t}')::INT" for t in terms)
    exact = ", ".join(f"'{t}'" for t in [*terms, query_.lower()])
    return f"by_name AS (SELECT * FROM (SELECT id, {covered} AS covered, (lower(name) IN ({exact}))::INT AS exact, length(name) AS length FROM symbols WHERE {where}) WHERE covered >= {2 if len(terms) >= 3 else 1} OR exact = 1)"


def _vector_sql(query_: str, where: str = "TRUE") -> str:
    parts = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(R.embed(query_)) if v)
    return f"by_vector AS (SELECT id, round(sum(x * q), 6) AS score FROM vectors JOIN (VALUES {parts}) AS q(k, q) ON dim = k WHERE {where} GROUP BY id)"


def _substring_sql(q: str, where: str = "TRUE") -> str:
    return f"""
sub_f AS (SELECT id, path, lang, kind, greatest(0, length(body) - 2) AS dl, (length(lower(body)) - length(replace(lower(body), '{q}', '')))::DOUBLE / {len(q)} AS f FROM symbols),
sub_s AS (SELECT count(*)::DOUBLE AS N, avg(dl) AS avgd, sum(CASE WHEN f > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hits FROM sub_f),
sub AS (SELECT id, round(greatest(ln((N - hits + 0.5::DOUBLE) / (hits + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgd)), 6) AS score FROM sub_f, sub_s WHERE f > 0 AND {where})"""


_ORDER = {"name": ("by_name", "covered DESC, exact DESC, length"), "bm25": ("bm25", "score DESC"), "vector": ("by_vector", "score DESC"), "trigram": ("sub", "score DESC")}


def _fused_sql(query_: str, limit: int, where: str = "TRUE") -> tuple[str, ...]:
    trigram = R.IDENTIFIER.fullmatch(query_)
    parts = [_bm25_sql(R.query_terms(query_), where), _name_sql(query_, where), _vector_sql(query_, f"id IN (SELECT id FROM symbols WHERE {where})"), *([_substring_sql(query_.lower(), where)] if trigram else [])]
    n, lists = R.pool(limit), []
    for k, (s, w) in enumerate(R.FUSION.items()):
        if s != "trigram" or trigram:
            t, order = _ORDER[s]
            lists.append(f"SELECT id, '{s}' AS source, {k} AS place, r, {w}::DOUBLE / ({R.RRF_K} + r + 1) AS part FROM (SELECT id, row_number() OVER (ORDER BY {order}, id) - 1 AS r FROM {t}) WHERE r < {n}")
    return (*parts, f"lists AS ({' UNION ALL '.join(lists)})", "fused AS (SELECT id, round(sum(part), 6) AS score, string_agg(source, ',' ORDER BY place) AS sources, min((place, r)) AS first FROM lists GROUP BY id)")


_FOLD = "CASE WHEN len(string_split(body, chr(10))) <= {m} THEN body ELSE array_to_string(string_split(body, chr(10))[1:{h}], chr(10)) || chr(10) || '... [' || (len(string_split(body, chr(10))) - {h} - {t}) || ' lines omitted] ...' || chr(10) || array_to_string(string_split(body, chr(10))[len(string_split(body, chr(10))) - {t} + 1:], chr(10)) END"
FOLD12 = _FOLD.format(m=12, h=8, t=3)


@query("bm25_search", with_corpus("SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 20", _bm25_sql(R.query_terms(QUERY))))
def bm25_search(spark, sf_dir):
    return R.bm25(Corpus.load(spark, sf_dir), QUERY).orderBy(F.desc("score"), "id").limit(20)


@query("name_search", with_corpus("SELECT id, covered, exact FROM by_name ORDER BY covered DESC, exact DESC, length, id LIMIT 50", _name_sql("the")))
def name_search(spark, sf_dir):
    return R.by_name(Corpus.load(spark, sf_dir).heads, "the").orderBy(F.desc("covered"), F.desc("exact"), "length", "id").limit(50).select("id", "covered", "exact")


@query("substring_search", with_corpus("SELECT id, score FROM sub ORDER BY score DESC, id LIMIT 20", _substring_sql("heed th")))
def substring_search(spark, sf_dir):
    return R.substring(Corpus.load(spark, sf_dir), "Heed th").orderBy(F.desc("score"), "id").limit(20)


_LANG = "lang = 'en' AND kind = 'block'"


@query("filter_symbols", with_corpus(f"SELECT id, path, name FROM symbols WHERE {_LANG} AND regexp_matches(path, '(^|/)doc_1[0-9]*[.]txt$') AND start_line <= 6"))
def filter_symbols(spark, sf_dir):
    keep = (F.col("lang") == "en") & (F.col("kind") == "block") & T.matches_glob(F.col("path"), "doc_1*.txt") & ~T.is_test(F.col("path"))
    return Corpus.load(spark, sf_dir).heads.where(keep & (F.col("start_line") <= 6)).select("id", "path", "name")


@query("rrf_fusion", with_corpus("SELECT id, score, sources FROM fused ORDER BY score DESC, first, id LIMIT 25", *_fused_sql(QUERY, 25)))
def rrf_fusion(spark, sf_dir):
    return R.fuse(R.rankings(Corpus.load(spark, sf_dir), QUERY, 25)).orderBy(F.desc("score"), "first", "id").limit(25).select("id", "score", "sources")


@query("hybrid_search", with_corpus(f"SELECT s.id, path, name, kind, start_line, score, sources, {FOLD12} AS preview FROM (SELECT * FROM fused ORDER BY score DESC, first, id LIMIT {LIMIT}) f JOIN symbols s ON f.id = s.id", *_fused_sql("the", LIMIT)))
def hybrid_search(spark, sf_dir):
    return R.hybrid(Corpus.load(spark, sf_dir), "the", LIMIT)


@query("hybrid_filtered", with_corpus(f"SELECT s.id, path, name, score, sources FROM (SELECT * FROM fused ORDER BY score DESC, first, id LIMIT {LIMIT}) f JOIN symbols s ON f.id = s.id", *_fused_sql(QUERY, LIMIT, _LANG)))
def hybrid_filtered(spark, sf_dir):
    return R.hybrid(Corpus.load(spark, sf_dir), QUERY, LIMIT, (F.col("lang") == "en") & (F.col("kind") == "block")).select("id", "path", "name", "score", "sources")


@query("semantic_search", with_corpus(f"SELECT s.id, path, name, round(1.0::DOUBLE / k, 6) AS score, 'vector' AS source FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM by_vector) v JOIN symbols s ON v.id = s.id WHERE k <= {LIMIT}", _vector_sql("de la que en")))
def semantic_search(spark, sf_dir):
    return R.semantic(Corpus.load(spark, sf_dir), "de la que en", LIMIT)


@query("find_similar", with_corpus("SELECT id, score FROM by_vector ORDER BY score DESC, id LIMIT 10", _vector_sql("der die und\nein von mit")))
def find_similar(spark, sf_dir):
    return R.by_vector(Corpus.load(spark, sf_dir).vectors, R.embed("der die und\nein von mit")).orderBy(F.desc("score"), "id").limit(10)


_Q = "[" + ", ".join(repr(x) for x in R.embed("any fixed query of words")) + "]"
_DOT = "list_sum([embedding[i]::DOUBLE * q[i] for i in range(1, 65)])"


def _knn_sql(where: str) -> str:
    return f"SELECT vec_id, round(sqrt(greatest(0.0::DOUBLE, 2 - 2 * least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {_DOT})))), 6) AS distance FROM embeddings, (SELECT {_Q}::DOUBLE[] AS q) WHERE {where} ORDER BY distance, vec_id LIMIT 10"


@query("knn", _knn_sql("TRUE"))
def knn(spark, sf_dir):
    return R.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), R.embed("any fixed query of words"), 10)


@query("knn_filtered", _knn_sql("label = 3"))
def knn_filtered(spark, sf_dir):
    return R.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label = 3"), R.embed("any fixed query of words"), 10)


@query("knn_join", "SELECT q_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, vec_id) AS k FROM (SELECT a.vec_id AS q_id, b.vec_id, round(list_sum([a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE for i in range(1, 65)]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE k <= 5")
def knn_join(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return R.neighbours(v.where("vec_id % 50 = 0"), v, 5)


@query("vec_math", "SELECT vec_id, round(list_sum([x::DOUBLE * x::DOUBLE for x in embedding]), 6) AS norm2, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 1 - pow(vec_id / 100.0::DOUBLE, 2) / 2)), 6) AS cosine FROM embeddings")
def vec_math(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", F.round(T.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"), F.round(T.cosine_from_l2(F.col("vec_id") / 100.0), 6).alias("cosine"))


@query("l2_normalize", "SELECT vec_id, round(list_max([x::DOUBLE for x in embedding]) * 3 / sqrt(list_sum([9 * x::DOUBLE * x::DOUBLE for x in embedding])), 5) AS top FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", F.round(F.array_max(T.l2_normal(F.transform("embedding", lambda x: x * 3.0))), 5).alias("top"))


@query("scan_files", with_corpus("SELECT path, lang, hash, size FROM files"))
def scan_files(spark, sf_dir):
    return Corpus.load(spark, sf_dir).files


@query("file_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("scan_guarded", "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents WHERE strlen(text) <= 20000")
def scan_guarded(spark, sf_dir):
    from quillmark.sources.files import guarded

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"), F.octet_length("text").alias("length"))
    return guarded(docs, 20_000).select("doc_id", F.col("length").cast("long").alias("size"))


@query("extract_symbols", with_corpus("SELECT id, path, name, kind, start_line, end_line, signature FROM symbols"))
def extract_symbols(spark, sf_dir):
    return Corpus.load(spark, sf_dir).symbols.select("id", "path", "name", "kind", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "signature")


@query("ref_owner", with_corpus("SELECT path, name, line, col, owner_id FROM refs"))
def ref_owner(spark, sf_dir):
    return Corpus.load(spark, sf_dir).refs


@query("containing_symbol", with_corpus("SELECT l.path, l.lineno AS line, o.owner_id FROM lines l LEFT JOIN owners o ON o.path = l.path AND o.line = l.lineno"))
def containing_symbol(spark, sf_dir):
    from quillmark.operators.joins import owner_of

    c = Corpus.load(spark, sf_dir)
    return owner_of(c.lines.select("path", F.col("lineno").cast("long").alias("line")), c.heads)


@query("fetch_symbols", with_corpus("SELECT id, s.path, name, f.lang AS file_lang, length(body)::BIGINT AS body_chars FROM symbols s JOIN files f ON s.path = f.path"))
def fetch_symbols(spark, sf_dir):
    c = Corpus.load(spark, sf_dir)
    return hydrate(c.heads.select("id"), c.symbols, c.files).select("id", "path", "name", "file_lang", F.length("body").cast("long").alias("body_chars"))


_STRIP = "regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g')"
_EMBED = f"{_STRIP.format("kind || ' ' || name || chr(10) || signature")} || chr(10) || chr(10) || substr({_STRIP.format('body')}, 1, 1800)"


@query("embed_rows", with_corpus("SELECT id, s.lang, length(body)::BIGINT AS n FROM symbols s JOIN files f ON s.path = f.path WHERE trim(body) <> '' AND kind = 'block'"))
def embed_rows(spark, sf_dir):
    c = Corpus.load(spark, sf_dir)
    return c.symbols.where("trim(body) <> '' AND kind = 'block'").join(c.files.select("path", "size"), "path").select("id", "lang", F.length("body").cast("long").alias("n"))


@query("embed_text", with_corpus(f"SELECT id, md5({_EMBED}) AS text FROM symbols"))
def embed_text(spark, sf_dir):
    t = T.embed_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("body"))
    return Corpus.load(spark, sf_dir).symbols.select("id", F.md5(t.cast("binary")).alias("text"))


@query("missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    docs, v = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings"))
    return missing(docs.select("doc_id"), v.select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("embed_backfill", with_corpus("SELECT id, count(*) AS parts, round(sum(x * x), 4) AS norm2, count(*) FILTER (WHERE x > 0) AS positive FROM vectors GROUP BY id"))
def embed_backfill(spark, sf_dir):
    """A store with vectors of two thirds of the blocks, and then of all: the last third is filled in."""
    import uuid

    from quillmark.functions.embedders import embedder
    from quillmark.sources.shared import shared_dir
    from quillmark.sources.vectors import VectorStore

    rows = Corpus.load(spark, sf_dir).symbols.where("kind = 'block'").select("id", F.col("body").alias("text"))
    stored = VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    for part in (rows.where("id % 3 <> 0"), rows):
        stored.backfill(part, embedder(f"digest-{DIM}"))
    x = F.filter("embedding", lambda v: v != 0)
    norm2 = F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")), 4)
    return stored.vectors().where(F.size(x) > 0).select(F.col("vec_id").alias("id"), F.size(x).cast("long").alias("parts"), norm2.alias("norm2"), F.size(F.filter("embedding", lambda v: v > 0)).cast("long").alias("positive"))


@query("min_lines", with_corpus("SELECT id FROM symbols WHERE end_line - start_line + 1 >= 5"))
def min_lines(spark, sf_dir):
    return Corpus.load(spark, sf_dir).heads.where("end_line - start_line + 1 >= 5").select("id")


@query("fold_preview", f"SELECT doc_id, {_FOLD.format(m=6, h=4, t=1).replace('body', 'text')} AS preview FROM documents")
def fold_preview(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.fold(F.col("text"), 6).alias("preview"))
