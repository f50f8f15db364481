"""Queries of the graph operators and the project's roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import aggregates as A
from quillmark.operators import graph as G
from quillmark.plans.corpus import Corpus, with_corpus
from quillmark.plans.registry import query
from quillmark.plans.search_queries import _fused_sql

#: A name that many symbols use, and one that few use.
NAME, RARE = "retion", "reened"
DEFS = "defs AS (SELECT name, min((path, start_line, id)) AS loc FROM symbols WHERE kind = 'block' GROUP BY name)"
CALLS = "calls AS (SELECT DISTINCT r.owner_id AS caller_id, s.name AS caller, s.path AS from_path, r.name AS callee FROM refs r JOIN symbols s ON r.owner_id = s.id WHERE r.name <> s.name)"
LOCAL = "near AS (SELECT path, name, min((path, start_line, id)) AS loc FROM symbols WHERE kind = 'block' GROUP BY ALL)"
STEPS = "steps AS (SELECT c.*, coalesce(n.loc, d.loc) AS loc FROM calls c LEFT JOIN near n ON n.path = c.from_path AND n.name = c.callee JOIN defs d ON d.name = c.callee)"
KEY = "CASE WHEN len(string_split({0}, '/')) = 1 THEN '.' WHEN len(string_split({0}, '/')) = 2 THEN string_split({0}, '/')[1] ELSE string_split({0}, '/')[1] || '/' || string_split({0}, '/')[2] END"
EDGES = f"""only_one AS (SELECT name, min(path) AS to_path FROM symbols WHERE kind = 'block' GROUP BY name HAVING count(DISTINCT path) = 1),
pe AS (SELECT src, dst, count(*) AS weight FROM (SELECT {KEY.format("path")} AS src, {KEY.format("to_path")} AS dst FROM uses u JOIN only_one o ON u.name = o.name WHERE path <> to_path) WHERE src <> dst GROUP BY src, dst),
pn AS (SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT src AS node, weight FROM pe UNION ALL SELECT dst, weight FROM pe) GROUP BY node ORDER BY degree DESC, node LIMIT 20)"""


def _c(spark, sf_dir) -> Corpus:
    return Corpus.load(spark, sf_dir)


@query("dependents", with_corpus(f"SELECT DISTINCT s.path, s.name, s.kind, s.start_line FROM refs r JOIN symbols s ON r.owner_id = s.id WHERE r.name = '{NAME}' AND s.name <> '{NAME}'"))
def dependents(spark, sf_dir):
    return G.dependents(_c(spark, sf_dir), NAME).distinct().withColumn("start_line", F.col("start_line").cast("long"))


@query("dependencies", with_corpus(f"SELECT f.callee AS name, coalesce(n.loc, d.loc)[1] AS path, coalesce(n.loc, d.loc)[2] AS start_line FROM (SELECT callee, min((path, start_line))[1] AS from_path FROM (SELECT r.name AS callee, s.path, s.start_line FROM refs r JOIN symbols s ON r.owner_id = s.id WHERE s.name = '{NAME}' AND s.kind = 'block' AND r.name <> '{NAME}') GROUP BY callee) f LEFT JOIN near n ON n.path = f.from_path AND n.name = f.callee JOIN defs d ON d.name = f.callee", DEFS, LOCAL))
def dependencies(spark, sf_dir):
    return G.dependencies(_c(spark, sf_dir), NAME).withColumn("start_line", F.col("start_line").cast("long"))


#: The callees of the symbols of a table of ids, and the tree's levels, one CTE each.
_CALLEES = """{n}_o AS MATERIALIZED (SELECT DISTINCT id FROM {front}),
{n}_c AS MATERIALIZED (SELECT DISTINCT r.owner_id AS caller_id, s.path AS from_path, r.name AS callee FROM refs r JOIN {n}_o o ON r.owner_id = o.id JOIN symbols s ON s.id = o.id WHERE r.name <> s.name),
{n}_n AS MATERIALIZED (SELECT name, path, min((path, start_line, id)) AS loc FROM symbols WHERE kind = 'block' AND name IN (SELECT callee FROM {n}_c) GROUP BY ALL),
{n} AS MATERIALIZED (SELECT c.caller_id, c.callee, coalesce(n.loc, f.loc) AS loc FROM {n}_c c LEFT JOIN {n}_n n ON n.path = c.from_path AND n.name = c.callee JOIN (SELECT name, min(loc) AS loc FROM {n}_n GROUP BY name) f ON f.name = c.callee)"""
_ROOT = "t0 AS MATERIALIZED (SELECT 0 AS depth, NULL::VARCHAR AS parent, '{name}' AS name, min((path, start_line, id))[3] AS id, coalesce(min((path, start_line, id))[3]::VARCHAR, '') AS trail, list_filter([min((path, start_line, id))[3]], lambda x: x IS NOT NULL) AS ids, TRUE AS open FROM symbols WHERE kind = 'block' AND name = '{name}')"


def _chain_sql(name: str, depth: int) -> tuple[str, ...]:
    out = [_ROOT.format(name=name)]
    for k in range(1, depth + 1):
        out.append(f"f{k} AS MATERIALIZED (SELECT * FROM t{k - 1} WHERE open AND id IS NOT NULL)")
        out.append(_CALLEES.format(n=f"s{k}", front=f"f{k}"))
        out.append(f"t{k} AS MATERIALIZED (SELECT {k} AS depth, f.name AS parent, s.callee AS name, s.loc[3] AS id, f.trail || '>' || s.loc[3] AS trail, list_append(f.ids, s.loc[3]) AS ids, NOT list_contains(f.ids, s.loc[3]) AS open FROM f{k} f JOIN s{k} s ON s.caller_id = f.id)")
    return (*out, "tree AS (" + " UNION ALL ".join(f"SELECT depth, parent, name, id, trail FROM t{k}" for k in range(depth + 1)) + ")")


def _impact_sql(name: str, depth: int) -> tuple[str, ...]:
    out = [_ROOT.format(name=name)]
    for k in range(1, depth + 1):
        out.append(f"f{k} AS MATERIALIZED (SELECT * FROM t{k - 1} WHERE open)")
        out.append(f"u{k} AS MATERIALIZED (SELECT DISTINCT r.name AS callee, s.id, s.name FROM refs r JOIN symbols s ON s.id = r.owner_id WHERE r.name IN (SELECT name FROM f{k}) AND s.name <> r.name)")
        out.append(f"t{k} AS MATERIALIZED (SELECT {k} AS depth, f.name AS parent, u.name, u.id, f.trail || '>' || u.id AS trail, list_append(f.ids, u.id) AS ids, NOT list_contains(f.ids, u.id) AS open FROM f{k} f JOIN u{k} u ON u.callee = f.name)")
    return (*out, "tree AS (" + " UNION ALL ".join(f"SELECT depth, parent, name, id, trail FROM t{k}" for k in range(depth + 1)) + ")")


@query("call_chain", with_corpus("SELECT * FROM tree", *_chain_sql(RARE, 3)))
def call_chain(spark, sf_dir):
    return G.call_chain(_c(spark, sf_dir), RARE, 3)


@query("change_impact", with_corpus("SELECT * FROM tree", *_impact_sql(RARE, 2)))
def change_impact(spark, sf_dir):
    return G.change_impact(_c(spark, sf_dir), RARE, 2)


_NEAR = (
    f"nd AS MATERIALIZED (SELECT id, name, path, start_line FROM symbols WHERE kind = 'block' AND name = '{RARE}')",
    _CALLEES.format(n="ns", front="nd"),
    f"""near1 AS MATERIALIZED (SELECT DISTINCT '{RARE}' AS of, 'caller' AS side, s.name, s.path, s.start_line FROM refs r JOIN symbols s ON s.id = r.owner_id WHERE r.name = '{RARE}' AND s.name <> '{RARE}'
 UNION SELECT '{RARE}', 'callee', callee, arg_min(loc, (path, start_line, id))[1], arg_min(loc, (path, start_line, id))[2] FROM ns JOIN nd ON nd.id = ns.caller_id GROUP BY callee)""",
    "nd2 AS MATERIALIZED (SELECT id, name, path, start_line FROM symbols WHERE kind = 'block' AND name IN (SELECT name FROM near1))",
    _CALLEES.format(n="ns2", front="nd2"),
    """near2 AS MATERIALIZED (SELECT DISTINCT r.name AS of, 'caller' AS side, s.name, s.path, s.start_line FROM refs r JOIN symbols s ON s.id = r.owner_id WHERE r.name IN (SELECT name FROM near1) AND s.name <> r.name
 UNION SELECT nd2.name, 'callee', callee, arg_min(loc, (path, start_line, id))[1], arg_min(loc, (path, start_line, id))[2] FROM ns2 JOIN nd2 ON nd2.id = ns2.caller_id GROUP BY nd2.name, callee)""",
)


@query("graph_neighbourhood", with_corpus(f"SELECT '{RARE}' AS of, 'definition' AS side, name, path, start_line FROM symbols WHERE name = '{RARE}' UNION ALL SELECT * FROM near1 UNION ALL SELECT * FROM near2", *_NEAR))
def graph_neighbourhood(spark, sf_dir):
    return G.neighbourhood(_c(spark, sf_dir), RARE, 2).withColumn("start_line", F.col("start_line").cast("long"))


_PATH = "src1/en/doc_1.txt"


@query("file_summary", with_corpus(f"SELECT s.path, s.symbols, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM uses WHERE path = '{_PATH}' AND name NOT IN (SELECT name FROM symbols WHERE path = '{_PATH}')), '') AS external FROM (SELECT path, string_agg(name, ',' ORDER BY start_line, end_line, name) AS symbols FROM symbols WHERE path = '{_PATH}' GROUP BY path) s"))
def file_summary(spark, sf_dir):
    return G.file_summary(_c(spark, sf_dir), _PATH)


@query("project_graph_edges", with_corpus("SELECT src, dst, weight FROM pe WHERE src IN (SELECT node FROM pn) AND dst IN (SELECT node FROM pn)", EDGES))
def project_graph_edges(spark, sf_dir):
    return G.project_graph(_c(spark, sf_dir), 20)[1]


@query("project_graph_nodes", with_corpus("SELECT node, degree FROM pn", EDGES))
def project_graph_nodes(spark, sf_dir):
    return G.project_graph(_c(spark, sf_dir), 20)[0]


@query("busiest", with_corpus("SELECT r.name, callers, loc[1] AS path, loc[2] AS start_line FROM (SELECT name, count(DISTINCT owner_id) AS callers FROM refs WHERE owner_id IS NOT NULL GROUP BY name) r JOIN defs d ON d.name = r.name ORDER BY callers DESC, r.name LIMIT 15", DEFS))
def busiest(spark, sf_dir):
    return G.busiest(_c(spark, sf_dir), 15).withColumn("start_line", F.col("start_line").cast("long"))


_COUNTS = "n AS (SELECT f.path, count(s.id) AS n_symbols FROM files f LEFT JOIN symbols s ON s.path = f.path GROUP BY f.path ORDER BY n_symbols DESC, f.path LIMIT 30)"


@query("project_map", with_corpus("SELECT n.path, n_symbols, string_agg(name, ',' ORDER BY k) AS symbols FROM n JOIN (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY start_line, end_line, name) AS k FROM symbols) s ON s.path = n.path AND k <= 12 GROUP BY ALL", _COUNTS))
def project_map(spark, sf_dir):
    return G.project_map(_c(spark, sf_dir), 30, 12)


@query("top_files", with_corpus("SELECT path, n_symbols FROM n", _COUNTS))
def top_files(spark, sf_dir):
    return G.project_map(_c(spark, sf_dir), 30, 1).select("path", "n_symbols")


@query("ambiguous_names", with_corpus("SELECT name, count(*) AS count FROM symbols GROUP BY name HAVING count(*) > 1"))
def ambiguous_names(spark, sf_dir):
    return G.ambiguous(_c(spark, sf_dir))


@query("defined_names", with_corpus("SELECT DISTINCT name FROM symbols"))
def defined_names(spark, sf_dir):
    return _c(spark, sf_dir).heads.select("name").distinct()


@query("call_sites", with_corpus(f"SELECT owner_id AS caller_id, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line) AS lines FROM (SELECT DISTINCT owner_id, line FROM refs WHERE name = '{NAME}') GROUP BY owner_id".replace("string_agg(DISTINCT", "string_agg(")))
def call_sites(spark, sf_dir):
    return G.call_sites(_c(spark, sf_dir), NAME)


@query("symbol_detail", with_corpus(f"SELECT s.path, s.name, s.start_line, s.body FROM defs d JOIN symbols s ON s.id = d.loc[3] WHERE d.name = '{NAME}'", DEFS))
def symbol_detail(spark, sf_dir):
    c = _c(spark, sf_dir)
    one = G.definitions(c).where(F.col("name") == NAME).select("id")
    return c.symbols.join(one, "id", "left_semi").select("path", "name", F.col("start_line").cast("long").alias("start_line"), "body")


@query("files_counts", with_corpus("SELECT f.path, (SELECT count(*) FROM symbols s WHERE s.path = f.path) AS n_symbols, (SELECT count(*) FROM uses u WHERE u.path = f.path) AS n_refs FROM files f"))
def files_counts(spark, sf_dir):
    c = _c(spark, sf_dir)
    a = c.heads.groupBy("path").agg(F.count("*").alias("n_symbols"))
    b = c.uses.groupBy("path").agg(F.count("*").alias("n_refs"))
    return c.files.select("path").join(a, "path", "left").join(b, "path", "left").fillna(0, ["n_symbols", "n_refs"])


@query("ref_counts", with_corpus("SELECT path, count(*) AS n FROM uses GROUP BY path"))
def ref_counts(spark, sf_dir):
    return _c(spark, sf_dir).uses.groupBy("path").agg(F.count("*").alias("n"))


@query("index_stats", with_corpus("SELECT lang, (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM uses) AS n_refs, count(*) AS n_files FROM files GROUP BY lang"))
def index_stats(spark, sf_dir):
    c = _c(spark, sf_dir)
    one = c.heads.agg(F.count("*").alias("n_symbols")).crossJoin(F.broadcast(c.uses.agg(F.count("*").alias("n_refs"))))  # one row each
    return c.files.groupBy("lang").agg(F.count("*").alias("n_files")).crossJoin(F.broadcast(one))


@query("lang_hist", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_hist(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"))


#: Files of several languages, as the tables have none: endings by the document's id.
_ENDINGS = (".py", ".PY", ".go", ".rs", ".rb", ".tsx", ".ts", ".md", ".json", ".py")
_MASKS = {"python": (".py", ".pyi"), "go": (".go",), "rust": (".rs",), "ruby": (".rb",), "typescript": (".ts", ".tsx"), "react": (".tsx",), "json": (".json",), "java": (".java",)}
_PROGRAMMING = ["python", "go", "rust", "ruby", "typescript", "java"]
_MIXED = "mixed AS (SELECT 'src/f' || doc_id || CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDINGS)) + " END AS path FROM documents)"


def _share_sql(lang: str, endings: tuple[str, ...]) -> str:
    hit = " OR ".join(f"ends_with(lower(path), '{e}')" for e in endings)
    return f"SELECT '{lang}' AS lang, round(100.0::DOUBLE * count(*) FILTER (WHERE {hit}) / count(*), 2) AS share, count(*) FILTER (WHERE {hit}) AS n FROM mixed"


_SHARES = "shares AS (" + " UNION ALL ".join(_share_sql(*x) for x in _MASKS.items()) + ")"
_KNOWN = ", ".join(f"'{x}'" for x in _PROGRAMMING)


def _mixed(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), ending).alias("path"))


@query("lang_share", f"WITH {_MIXED}, {_SHARES} SELECT lang, share FROM shares WHERE n > 0")
def lang_share(spark, sf_dir):
    return A.composition(_mixed(spark, sf_dir), _MASKS)


@query("lang_significant", f"WITH {_MIXED}, {_SHARES} SELECT lang, share FROM shares WHERE share >= 10 AND lang IN ({_KNOWN}) ORDER BY share DESC, lang LIMIT 4")
def lang_significant(spark, sf_dir):
    return A.significant(A.composition(_mixed(spark, sf_dir), _MASKS), _PROGRAMMING)


@query("group_key", with_corpus(f"SELECT path, {KEY.format('path')} AS key FROM files"))
def group_key(spark, sf_dir):
    return _c(spark, sf_dir).files.select("path", T.group_key(F.col("path")).alias("key"))


_FOLD80 = "CASE WHEN len(string_split(body, chr(10))) <= 80 THEN body ELSE array_to_string(string_split(body, chr(10))[1:53], chr(10)) || chr(10) || '... [' || (len(string_split(body, chr(10))) - 79) || ' lines omitted] ...' || chr(10) || array_to_string(string_split(body, chr(10))[len(string_split(body, chr(10))) - 25:], chr(10)) END"
_SHOW = "string_agg(name || '@' || path || ':' || start_line || CASE WHEN speculative THEN '?' ELSE '' END, ' ' ORDER BY k)"
_CONTEXT = (
    "focus AS MATERIALIZED (SELECT s.* FROM (SELECT * FROM fused ORDER BY score DESC, first, id LIMIT 3) f JOIN symbols s ON s.id = f.id)",
    _CALLEES.format(n="cs", front="focus"),
    "many AS (SELECT name FROM symbols GROUP BY name HAVING count(*) > 1)",
    """edges AS MATERIALIZED (SELECT DISTINCT f.id AS of, CASE WHEN regexp_matches(lower(s.path), 'test|spec') THEN 'tests' ELSE 'called_by' END AS side, s.name, s.path, s.start_line FROM refs r JOIN symbols s ON s.id = r.owner_id JOIN focus f ON f.name = r.name WHERE s.name <> r.name
 UNION ALL SELECT caller_id, 'calls', callee, loc[1], loc[2] FROM cs WHERE NOT regexp_matches(lower(loc[1]), 'test|spec'))""",
    "ranked AS (SELECT *, name IN (SELECT name FROM many) AS speculative, row_number() OVER (PARTITION BY of, side ORDER BY path, start_line, name) AS k FROM edges)",
    f"listed AS (SELECT of, side, {_SHOW} AS shown FROM ranked WHERE k <= 5 GROUP BY of, side)",
)


@query("code_context", with_corpus(f"""SELECT id, path, name, kind, start_line, end_line, md5({_FOLD80}) AS code, len(string_split(regexp_replace(body, '\\n$', ''), chr(10))) > 80 AS truncated,
 coalesce((SELECT shown FROM listed WHERE of = focus.id AND side = 'called_by'), '') AS called_by, coalesce((SELECT shown FROM listed WHERE of = focus.id AND side = 'calls'), '') AS calls, coalesce((SELECT shown FROM listed WHERE of = focus.id AND side = 'tests'), '') AS tests FROM focus""", *_fused_sql(NAME, 3), *_CONTEXT))
def code_context(spark, sf_dir):
    out = G.code_context(_c(spark, sf_dir), NAME)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("@"), x["path"], F.lit(":"), x["start_line"].cast("string"), F.when(x["speculative"], "?").otherwise(""))), " ").alias(c)
    return out.select("id", "path", "name", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("code").cast("binary")).alias("code"), "truncated", shown("called_by"), shown("calls"), shown("tests"))
