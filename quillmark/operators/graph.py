"""Graph queries over definitions and references: callers, callees, bounded trees, impact, hierarchy, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import OVERVIEW_EXCLUDED, TYPE_KINDS, any_rlike, base_names, glob_regex, group_key
from quillmark.plans.corpus import Corpus
from quillmark.sources.shared import checkpointed


def call_edges(corpus: Corpus) -> DataFrame:
    """(caller_id, callee): names that a symbol's own references use, other than its own name."""
    own = corpus.heads.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    used = corpus.refs.where("owner_id is not null").select(F.col("owner_id").alias("caller_id"), F.col("name").alias("callee")).distinct()
    return used.join(own, "caller_id").where("caller <> callee").select("caller_id", "caller", "callee")


def dependents(corpus: Corpus, name: str) -> DataFrame:
    """Symbols that use the name."""
    using = corpus.refs.where(F.col("name") == name).select(F.col("owner_id").alias("id")).distinct()
    return corpus.heads.join(using, "id", "left_semi").where(F.col("name") != name).select("path", "name", "kind", "start_line")


def definitions(corpus: Corpus) -> DataFrame:
    """The first definition of each block name."""
    at = F.struct("path", "start_line", "id")
    return corpus.heads.where("kind = 'block'").groupBy("name").agg(F.min(at).alias("at")).select("name", "at.path", "at.start_line", "at.id")


def targets(uses: DataFrame, corpus: Corpus) -> DataFrame:
    """uses (from_path, callee, ...) with the definition they mean: of the same file first, then by path and line."""
    defs = corpus.heads.where("kind = 'block'")
    local = defs.groupBy(F.col("path").alias("from_path"), F.col("name").alias("callee")).agg(F.min(F.struct("path", "start_line", "id")).alias("near"))
    first = defs.groupBy(F.col("name").alias("callee")).agg(F.min(F.struct("path", "start_line", "id")).alias("far"))
    return uses.join(local, ["from_path", "callee"], "left").join(first, "callee").withColumn("to", F.coalesce("near", "far")).drop("near", "far")


def dependencies(corpus: Corpus, name: str) -> DataFrame:
    """Definitions that the bodies of the name's definitions use, one for each name."""
    own = corpus.heads.where((F.col("name") == name) & (F.col("kind") == "block")).select(F.col("id").alias("owner_id"), F.col("path").alias("from_path"), "start_line")
    used = corpus.refs.where(F.col("name") != name).select("owner_id", F.col("name").alias("callee")).distinct().join(own, "owner_id")
    first = used.groupBy("callee").agg(F.min(F.struct("from_path", "start_line")).alias("of")).select("callee", "of.from_path")
    return targets(first, corpus).select(F.col("callee").alias("name"), "to.path", "to.start_line")


def callees_of(corpus: Corpus, callers: DataFrame) -> DataFrame:
    """(caller_id, callee, to): what the symbols of callers (caller_id, distinct) use, with the definition meant.

    The references of these symbols alone are kept before names are resolved, and only their names' definitions are read."""
    own = corpus.heads.join(callers, F.col("id") == F.col("caller_id")).select("caller_id", F.col("name").alias("caller"), F.col("path").alias("from_path"))
    used = corpus.refs.select(F.col("owner_id").alias("caller_id"), F.col("name").alias("callee")).join(callers, "caller_id", "left_semi").distinct()
    steps = checkpointed(used.join(own, "caller_id").where("caller <> callee").select("caller_id", "callee", "from_path"))
    names = steps.select(F.col("callee").alias("name")).distinct()
    defs = corpus.heads.where("kind = 'block'").join(names, "name", "left_semi").groupBy("name", "path").agg(F.min(F.struct("path", "start_line", "id")).alias("near"))
    local = defs.select(F.col("path").alias("from_path"), F.col("name").alias("callee"), "near")
    first = defs.groupBy(F.col("name").alias("callee")).agg(F.min("near").alias("far"))
    return steps.join(local, ["from_path", "callee"], "left").join(first, "callee").select("caller_id", "callee", F.coalesce("near", "far").alias("to"))


def call_chain(corpus: Corpus, name: str, depth: int = 3) -> DataFrame:
    """(depth, parent, name, id, trail): the forward tree from the first definition of the name, which is there with a null id
    if there is none. A child already on its branch is given, but not continued. Only the frontier's symbols are expanded, each
    once a level however many branches it is on; a level is checkpointed, so none is computed twice."""
    root = corpus.documents.sparkSession.createDataFrame([(name,)], "name string")
    now = root.join(definitions(corpus).where(F.col("name") == name).select("name", "id"), "name", "left")
    now = now.select(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), "name", "id", F.array_compact(F.array("id")).alias("trail"), F.col("id").isNotNull().alias("open"))
    out = now = checkpointed(now)
    for k in range(1, depth + 1):
        front = now.where("open")
        steps = callees_of(corpus, front.select(F.col("id").alias("caller_id")).distinct())
        grown = front.select(F.col("name").alias("parent"), F.col("id").alias("caller_id"), "trail").join(steps, "caller_id")
        now = checkpointed(grown.select(F.lit(k).alias("depth"), "parent", F.col("callee").alias("name"), F.col("to.id").alias("id"), F.concat("trail", F.array("to.id")).alias("trail"), (~F.array_contains("trail", F.col("to.id"))).alias("open")))
        out = out.unionByName(now)
    return out.select("depth", "parent", "name", "id", F.array_join(F.transform("trail", lambda x: x.cast("string")), ">").alias("trail"))


def callers_of(corpus: Corpus, names: DataFrame) -> DataFrame:
    """(callee, id, name): the symbols that use the names, but for those of the same name."""
    used = corpus.refs.where("owner_id is not null").select(F.col("name").alias("callee"), F.col("owner_id").alias("id")).join(names.select(F.col("name").alias("callee")), "callee", "left_semi").distinct()
    return used.join(corpus.heads.select("id", "name"), "id").where("name <> callee").select("callee", "id", "name")


def change_impact(corpus: Corpus, name: str, depth: int = 3) -> DataFrame:
    """(depth, parent, name, id, trail): the reverse tree, by name alone: symbols that use the name, and symbols that use their
    names. The root is there, defined or not. A symbol already on its branch is given, but not continued."""
    root = corpus.documents.sparkSession.createDataFrame([(name,)], "name string")
    now = root.join(definitions(corpus).where(F.col("name") == name).select("name", "id"), "name", "left")
    now = now.select(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), "name", "id", F.array_compact(F.array("id")).alias("trail"), F.lit(True).alias("open"))
    out = now = checkpointed(now)
    for k in range(1, depth + 1):
        front = now.where("open")
        up = callers_of(corpus, front.select("name").distinct()).select(F.col("callee").alias("parent"), "id", F.col("name").alias("child"))
        grown = front.select(F.col("name").alias("parent"), "trail").join(up, "parent")
        now = checkpointed(grown.select(F.lit(k).alias("depth"), "parent", F.col("child").alias("name"), "id", F.concat("trail", F.array("id")).alias("trail"), (~F.array_contains("trail", F.col("id"))).alias("open")))
        out = out.unionByName(now)
    return out.select("depth", "parent", "name", "id", F.array_join(F.transform("trail", lambda x: x.cast("string")), ">").alias("trail"))


def neighbourhood(corpus: Corpus, name: str, depth: int = 1) -> DataFrame:
    """(of, side, name, path, start_line): the name's definitions, callers and callees; at a depth above 1 also those two of each
    distinct caller and callee, once."""
    spark = corpus.documents.sparkSession
    asked = spark.createDataFrame([(name,)], "name string")
    place = corpus.heads.select("id", "path", "start_line")

    def both(names: DataFrame) -> DataFrame:
        up = callers_of(corpus, names).join(place, "id").select(F.col("callee").alias("of"), F.lit("caller").alias("side"), "name", "path", "start_line")
        own = corpus.heads.where("kind = 'block'").join(names, "name", "left_semi").select(F.col("id").alias("caller_id"), F.col("name").alias("of"), "path", "start_line")
        down = callees_of(corpus, own.select("caller_id")).join(own, "caller_id")
        first = down.groupBy("of", "callee").agg(F.min_by("to", F.struct("path", "start_line", "caller_id")).alias("to"))
        return up.unionByName(first.select("of", F.lit("callee").alias("side"), F.col("callee").alias("name"), "to.path", "to.start_line")).distinct()

    near = checkpointed(both(asked))
    out = corpus.heads.where(F.col("name") == name).select(F.lit(name).alias("of"), F.lit("definition").alias("side"), "name", "path", "start_line").unionByName(near)
    if depth > 1:
        out = out.unionByName(both(near.select("name").distinct()))
    return out


def code_context(corpus: Corpus, query: str, limit: int = 3, body_lines: int = 80, related: int = 5, tests: bool = True, allowed=None) -> DataFrame:
    """(id, path, name, kind, start_line, end_line, code, truncated, called_by, calls, tests) of the symbols that a hybrid search
    finds outside of tests, or, where it finds none, in them: folded bodies, and the first `related` callers, callees and tests
    by place, each (name, path, start_line, speculative); speculative: the name has several definitions."""
    from quillmark.functions.text import fold, is_test, test_hint
    from quillmark.operators.retrieval import hybrid

    outside = ~is_test(F.col("path"))
    hits = checkpointed(hybrid(corpus, query, limit, outside if allowed is None else outside & allowed).select("id", "score"))
    if hits.isEmpty():
        hits = checkpointed(hybrid(corpus, query, limit, allowed).select("id", "score"))
    focus = checkpointed(corpus.symbols.join(hits.select("id"), "id", "left_semi"))  # limit rows
    many = ambiguous(corpus).select("name", F.lit(True).alias("speculative"))
    place = corpus.heads.select("id", "path", "start_line")
    up = callers_of(corpus, focus.select("name").distinct()).join(place, "id").join(focus.select(F.col("name").alias("callee"), F.col("id").alias("of")), "callee").select("of", F.when(test_hint(F.col("path")), "tests").otherwise("called_by").alias("side"), "name", "path", "start_line").distinct()
    down = callees_of(corpus, focus.select(F.col("id").alias("caller_id"))).select(F.col("caller_id").alias("of"), F.lit("calls").alias("side"), F.col("callee").alias("name"), "to.path", "to.start_line").where(~test_hint(F.col("path")))
    rows = up.unionByName(down).join(many, "name", "left").withColumn("speculative", F.coalesce("speculative", F.lit(False)))
    order = Window.partitionBy("of", "side").orderBy("path", "start_line", "name")
    first = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= related)
    listed = first.groupBy("of").pivot("side", ["called_by", "calls", "tests"]).agg(F.array_sort(F.collect_list(F.struct("k", "name", "path", "start_line", "speculative"))))
    bare = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(dict(listed.dtypes)[c])), lambda x: x.dropFields("k")).alias(c)
    lines = F.size(F.split(F.regexp_replace("body", "\n$", ""), "\n", -1))
    out = focus.join(listed, focus["id"] == listed["of"], "left")
    kept = ["called_by", "calls", *(["tests"] if tests else [])]
    return out.select("id", "path", "name", "kind", "start_line", "end_line", fold(F.col("body"), body_lines).alias("code"), (lines > body_lines).alias("truncated"), *(bare(c) for c in kept))


def type_hierarchy(types: DataFrame, name: str) -> DataFrame:
    """(side, name, path, start_line): the type itself (item, its first definition), its supertypes and its subtypes, by the
    base names of declarations; only names of given types count. types: (name, kind, path, start_line, signature).

    Types of one name aren't told apart: a supertype stands at its last definition by place.
    """
    known = types.where(F.col("kind").isin(*TYPE_KINDS))
    at = F.struct("path", "start_line")
    mine = known.where(F.col("name") == name)
    item = mine.agg(F.min(at).alias("at")).where("at is not null").select(F.lit("item").alias("side"), F.lit(name).alias("name"), "at.path", "at.start_line")
    bases = mine.select(F.explode(base_names(F.col("name"), F.col("signature"))).alias("name")).where(F.col("name") != name).distinct()
    up = known.join(bases, "name", "left_semi").groupBy("name").agg(F.max(at).alias("at")).select(F.lit("super").alias("side"), "name", "at.path", "at.start_line")
    down = known.where((F.col("name") != name) & F.array_contains(base_names(F.col("name"), F.col("signature")), name)).select(F.lit("sub").alias("side"), "name", "path", "start_line")
    return item.unionByName(up).unionByName(down)


def file_summary(corpus: Corpus, path: str) -> DataFrame:
    """One row: the file's symbols by line, and the defined names that it uses but doesn't define."""
    own = corpus.heads.where(F.col("path") == path)
    inner = own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))), lambda x: x["name"]), ",").alias("symbols"), F.collect_set("name").alias("own"))
    used = corpus.uses.where(F.col("path") == path).groupBy("path").agg(F.collect_set("name").alias("used"))
    return inner.join(used, "path", "left").select("path", "symbols", F.array_join(F.sort_array(F.array_except(F.coalesce("used", F.array().cast("array<string>")), "own")), ",").alias("external"))


def project_edges(corpus: Corpus) -> DataFrame:
    """(src, dst, weight): references across files to names with one defining file, rolled up to folders."""
    only = checkpointed(corpus.heads.where("kind = 'block'").groupBy("name").agg(F.min("path").alias("to_path"), F.max("path").alias("last")).where("to_path = last").select("name", "to_path"))
    cross = corpus.uses.select("name", "path").join(only, "name").where("path <> to_path")
    return cross.groupBy(group_key(F.col("path")).alias("src"), group_key(F.col("to_path")).alias("dst")).agg(F.count("*").alias("weight")).where("src <> dst")


def project_nodes(edges: DataFrame, limit: int) -> DataFrame:
    """(node, degree): the nodes of the largest weighted degree."""
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("degree")).orderBy(F.desc("degree"), "node").limit(limit)


def project_graph(corpus: Corpus, limit: int) -> tuple[DataFrame, DataFrame]:
    """The largest nodes, and the edges between them; the roll-up is made once."""
    edges = checkpointed(project_edges(corpus))
    nodes = project_nodes(edges, limit)
    return nodes, kept_edges(edges, checkpointed(nodes))


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def busiest(corpus: Corpus, limit: int, excluded: tuple[str, ...] = OVERVIEW_EXCLUDED) -> DataFrame:
    """(name, callers, path, start_line): names by the number of symbols that use them, at their first definition outside the
    excluded paths."""
    n = corpus.refs.where("owner_id is not null").groupBy("name").agg(F.count_distinct("owner_id").alias("callers"))
    shown = corpus.heads.where(~any_rlike(F.col("path"), [glob_regex(g) for g in excluded]) & (F.col("kind") == "block"))
    first = shown.groupBy("name").agg(F.min(F.struct("path", "start_line", "id")).alias("at")).select("name", "at.path", "at.start_line")
    return n.join(first, "name").orderBy(F.desc("callers"), "name").limit(limit).select("name", "callers", "path", "start_line")


def project_map(corpus: Corpus, files: int, most: int) -> DataFrame:
    """(path, n_symbols, symbols): the files of most symbols, with their first ones by line."""
    n = corpus.files.select("path").join(corpus.heads.groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_symbols"))
    top = n.orderBy(F.desc("n_symbols"), "path").limit(files)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "end_line", "name"))
    first = corpus.heads.join(top, "path", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most)
    names = first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("symbols"))
    return top.join(names, "path", "left")


def ambiguous(corpus: Corpus) -> DataFrame:
    return corpus.heads.groupBy("name").count().where("count > 1").select("name", "count")


def call_sites(corpus: Corpus, name: str) -> DataFrame:
    """(caller_id, lines): where each symbol uses the name."""
    return corpus.refs.where((F.col("name") == name) & F.col("owner_id").isNotNull()).groupBy(F.col("owner_id").alias("caller_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("lines"))
