"""Sources, edits, name paths, embedders, streams and runs, on small rows written by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import edits as E
from quillmark.functions import embedders, testruns
from quillmark.functions import text as T
from quillmark.functions.gitignore import ignored_below
from quillmark.functions.similarity import plain_text
from quillmark.operators import aggregates as A
from quillmark.operators import graph as G
from quillmark.operators import joins, references, scan, tree
from quillmark.plans.corpus import Corpus
from quillmark.sources import code, files, git, vectors
from quillmark.streaming import incremental, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# -- functions


@pytest.mark.parametrize(("signature", "bases"), [("class X(A, b.B):", ["A", "B"]), ("class X extends A implements C { extends Z", ["A", "C"]), ("struct X : public Base", ["Base"]), ("impl T for Y", ["T", "Y"]), ("class X", []), ("class X(X, A, A)", ["A"])])
def test_base_names(spark, signature, bases):
    assert value(spark, T.base_names(F.lit("X"), F.lit(signature))) == bases


@pytest.mark.parametrize(("glob", "text", "hit"), [("a?c", "xabbcx", True), ("a?c", "abc", False), ("a*c", "a--c", True), ("a\\\\*c", "a*c", True), ("a\\\\*c", "abc", False), ("a.c", "abc", False)])
def test_search_globs(spark, glob, text, hit):
    assert value(spark, F.lit(text).rlike(T.search_regex(glob.replace("\\\\", "\\")))) is hit


@pytest.mark.parametrize(("path", "lang"), [("a/b.PY", "python"), ("a.b/c", None), (".py", None), ("a/.py", None), ("x.d.ts", "typescript"), ("x.unknown", None)])
def test_languages(spark, path, lang):
    assert value(spark, T.language_of(F.lit(path))) == lang


@pytest.mark.parametrize(("path", "hit"), [("a/testing/b.c", True), ("a/FooTest.kt", True), ("Tests.py", True), ("x_test.go", True), ("contest.py", False), ("atest/b.py", False)])
def test_test_paths(spark, path, hit):
    assert value(spark, T.is_test(F.lit(path))) is hit


def test_nested_ignore_files(spark):
    specs = {"": ["*.log", "!keep.log"], "sub": ["keep.log", "/only"], "sub/deep": ["!x.log"]}
    hit = lambda p: value(spark, ignored_below(F.lit(p), specs))
    assert hit("a.log") and not hit("keep.log") and hit("sub/keep.log") and hit("sub/only") and not hit("sub/x/only2")
    assert hit("sub/deep/x.log")  # taken back in one list, still ignored by another
    assert hit(".git/config") and not hit(".github/x")


def test_replacement(spark):
    run = lambda text, *a, **k: spark.range(1).select(*(c.alias(n) for c, n in zip(E.replaced(F.lit(text), *a, **k), "xne", strict=True))).first()
    assert tuple(run("a1 b", r"([a-z])(\\d)".replace("\\\\", "\\"), "$!2$!1$")) == ("1a$ b", 1, None)
    assert run("aa", "a", "b").e == "2 matches" and run("aa", "a", "b", several=True).x == "bb" and run("x", "a", "b").e == "no match"
    assert run("a.b", ".", "-", regex=False).x == "a-b" and run("a$b", "$", "\\\\", regex=False).x == "a\\\\b"
    twice = "start one\nstart two\nend"
    assert run(twice, "start.*?end", "x").e == "ambiguous" and run(twice, "start two.*?end", "x").x == "start one\nx"


def test_symbol_edits(spark):
    text = F.lit("def a():\n    pass\ndef b():\n    pass")
    assert value(spark, E.insert_after_symbol(text, 1, "def c(): pass")) == "def a():\n    pass\n\ndef c(): pass\ndef b():\n    pass"
    assert value(spark, E.insert_after_symbol(text, 1, "x = 1", apart=False)).split("\n")[2] == "x = 1"
    assert value(spark, E.insert_before_symbol(text, 2, "def c(): pass\n")) == "def a():\n    pass\ndef c(): pass\n\ndef b():\n    pass"
    assert value(spark, E.replace_body(text, 2, 0, 3, 8, " new \n")) == "def a():\n    pass\nnew"
    assert value(spark, E.delete_symbol(text, 0, 0, 2, 0)) == "def b():\n    pass"
    assert value(spark, E.body_span(text, 0, 4, 1, 8)) == "a():\n    pass" and value(spark, E.body_span(text, 0, 4, 0, 5)) == "a"
    assert tuple(value(spark, E.first_match(text, r"def (b)\\(".replace("\\\\", "\\")))) == (2, 4) and value(spark, E.first_match(text, "def ([ab])", unique=True)) is None


def test_plain_text_leaves_scripts_out():
    assert plain_text("<p>a<script>var x = '<p>';</script><style>q{}</style> b</p><!-- no --><template>t</template>&nbsp;c") == "a b c"


def test_display_and_fields(spark):
    assert value(spark, scan.display(F.lit(0), F.lit(7), F.lit("x"))) == "  >   7:x" and value(spark, scan.display(F.lit(-1), F.lit(12345), F.lit("x"))) == "...12345:x"
    assert value(spark, scan.decoded(F.lit('{"text": "a"}'))) == "a" and value(spark, scan.decoded(F.lit('{"bytes": "YcM="}'))) == "a\ufffd" and value(spark, scan.decoded(F.lit("{}"))) == ""


def test_run_summaries(spark):
    of = lambda f, out: value(spark, testruns.summary(F.lit(f), F.lit(out))).asDict()
    assert of("pytest", "2 failed, 3 passed, 1 error, 4 xfailed in 1s") | {"skipped": None} == {"passed": 3, "failed": 2, "error": 1, "skipped": None, "xfailed": 4, "xpassed": None}
    assert of("cargo", "test result: FAILED. 5 passed; 1 failed; 0 ignored")["failed"] == 1 and of("go", "--- PASS: a\n--- PASS: b\n--- FAIL: c")["passed"] == 2
    assert of("maven", "3 passed")["passed"] is None


# -- sources


def test_status_records(spark):
    raw = " M a b\0R  new\0R  old\0C  c2\0c1\0?? u\0D  gone\0!! ig\0"
    got = git.status_entries(spark.createDataFrame([(1, raw), (2, "")], "repo int, status string")).orderBy("k").collect()
    assert [(r.status, r.path, r.original_path) for r in got] == [("M", "a b", None), ("R", "new", "R  old"), ("C", "c2", "c1"), ("??", "u", None), ("D", "gone", None), ("!!", "ig", None)]
    assert (got[0].index_status, got[0].worktree_status) == ("", "M") and (got[4].index_status, got[4].worktree_status) == ("D", "")
    sides = {r.path: r.side for r in git.changed_and_deleted(git.status_entries(spark.createDataFrame([(1, raw)], "repo int, status string"))).collect()}
    assert sides == {"a b": "changed", "new": "changed", "c2": "changed", "u": "changed", "gone": "deleted"}


def test_changelog_and_messages(spark):
    subjects = ["feat(x): one", "FIX!: two", "feat: three", "feature: four", "no type", "docs:five"]
    log = git.changelog(spark.createDataFrame(list(enumerate(subjects)), "k int, subject string"))
    assert {r.section: r.entries for r in log.collect()} == {"Features": ["one", "three"], "Fixes": ["two"], "Documentation": ["five"], "Other": ["feature: four", "no type"]}
    text = git.markdown(log.withColumn("repo", F.lit(1)), ["repo"], F.lit("v1"), F.lit("HEAD")).first().text
    assert text == "# Changelog (v1..HEAD)\n\n## Features\n- one\n- three\n\n## Fixes\n- two\n\n## Documentation\n- five\n\n## Other\n- feature: four\n- no type\n"
    clean = lambda m: value(spark, git.sanitized(F.lit(m)))
    assert clean("a\n\n\n\nb\nCo-Authored-By: Copilot <x>\n") == "a\n\nb\n" and clean("Co-authored-by: Ann <x>") == "Co-authored-by: Ann <x>\n"
    assert git.needs_full_pass("a", "b", set(), set()) and git.needs_full_pass("a", "a", set(), None) and git.needs_full_pass("a", "a", set(), {".gitignore"}) and not git.needs_full_pass("a", "a", {"x"}, set())


def test_python_symbols(spark):
    source = "import os\nLIMIT: int = 3\nA = B = 1\n\nclass C(Base):\n    def m(self):\n        return os.path.join(f(1))\n\nasync def g():\n    pass\n"
    rows = spark.createDataFrame([("a.py", "python", source), ("bad.py", "python", "def ("), ("x.go", "go", "func f() {}"), ("n.py", "python", None)], "path string, lang string, content string")
    symbols, refs = code.extract(rows)
    assert [(r.name, r.kind, r.start_line, r.end_line) for r in symbols.orderBy("start_line", "name").collect()] == [("LIMIT", "constant", 2, 2), ("A", "constant", 3, 3), ("B", "constant", 3, 3), ("C", "class", 5, 7), ("m", "function", 6, 7), ("g", "function", 9, 10)]
    assert [(r.name, r.line, r.col) for r in refs.orderBy("col").collect()] == [("join", 7, 23), ("f", 7, 28)]
    words = lambda s: ([(w, "word", 1, 1, w, w) for w in s.split()], [])
    assert code.extract(rows, {"go": words})[0].count() == 3


def test_a_cache_parses_changed_files_only(spark, tmp_path):
    at, asked = f"file://{tmp_path}/cache", f"{tmp_path}/asked"

    def spy(source):
        with open(asked, "a") as f:
            f.write(source + "|")
        return [(source, "word", 1, 1, source, source)] if source != "none" else [], []

    run = lambda *rows: {r.name for r in code.cached_extract(spark.createDataFrame(list(rows), "path string, lang string, content string"), at, 1, {"x": spy})[0].collect()}
    assert run(("a", "x", "one"), ("b", "x", "none"), ("c", "y", "two")) == {"one"}
    assert run(("a", "x", "one"), ("b", "x", "none"), ("d", "x", "three")) == {"one", "three"}
    assert run(("a", "x", "four"), ("b", "x", "none")) == {"four"} and run(("a", "x", "one")) == {"one"}
    with open(asked) as f:
        assert sorted(f.read().split("|")) == ["", "four", "none", "one", "three"]


def test_locations_of_several_servers(spark):
    rows = spark.createDataFrame([("a", 1, 0, "class", "X", "s2"), ("a", 1, 0, "class", "X", "s1"), ("a", 1, 0, "method", "X", "s1")], "path string, line int, col int, kind string, name string, server string")
    assert sorted((r.kind, r.server) for r in tree.distinct_locations(rows).collect()) == [("class", "s1"), ("method", "s1")]
    assert tree.distinct_locations(rows.select("path", "line", "col", "kind")).count() == 2


def test_a_tree_of_files(spark, tmp_path):
    for name, body in {"a.py": "x = 1", "b/c.go": "package c", "node_modules/d.js": "1", "b/e.bin": "z", "f.py": "a\0b", "g.rs": "fn"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: (r.lang, r.content) for r in files.tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", "x = 1"), "b/c.go": ("go", "package c"), "g.rs": ("rust", "fn")}
    assert {r.path for r in files.tree(spark, str(tmp_path), include=["**/*.{py,go}"], exclude=["b/*"]).collect()} == {"a.py"}
    paths = spark.createDataFrame([("a/b/c.py",), ("a/d.md",), ("venv/x.py",), ("e.md",)], "path string")
    assert {(r.kind, r.path, r.files) for r in files.listing(paths).collect()} == {("folder", "a", 2), ("folder", "a/b", 1), ("file", "a/b/c.py", 1), ("file", "a/d.md", 1), ("file", "e.md", 1)}
    assert {r.path for r in files.listing(paths, "a", recursive=False).collect()} == {"b", "d.md"} and {r.name for r in files.notes(paths).collect()} == {"a/d", "e"}
    stamp = lambda rows: files.fingerprint(spark.createDataFrame(rows, "path string, size long, mtime long")).first().revision
    assert stamp([("a", 1, 2), ("b", 1, 2)]) == stamp([("b", 1, 2), ("a", 1, 2)]) != stamp([("a", 1, 2), ("b", 1, 3)]) and stamp([])


def test_embedders_and_their_store(spark, tmp_path):
    h = embedders.embedder("hashing-8")
    one = np.zeros(8)
    for w in ("ab", "_c1", "ab"):
        d = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        one[d % 8] += 1 if d >> 63 else -1
    assert np.allclose(h.embed_query("Ab _c1 ab 12"), one / np.linalg.norm(one)) and h.embed_query("12") == [0.0] * 8
    assert embedders.embedder("auto").id == "hashing-256" and h.batch_size_for(10_000) == 1 and h.batch_size_for(10) == 128
    with pytest.raises(ValueError):
        embedders.embedder("nothing-1")

    class Model(embedders.Embedder):
        id, dim = "model-2", 2

        def embed_documents(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    store = vectors.VectorStore(spark, f"file://{tmp_path}/vectors")
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, " "), (4, None)], "id long, text string")
    assert not store.any() and store.backfill(rows.where("id = 1"), Model()) == "rebuilt" and store.backfill(rows, Model()) == "filled"
    assert {r.vec_id: r.embedding for r in store.vectors().collect()} == {1: [1.0, 1.0], 2: [2.0, 1.0]}
    assert store.backfill(rows, h, explicit=False) == "kept" and store.pointer()[0] == "model-2"
    assert store.backfill(rows, h) == "rebuilt" and {len(r.embedding) for r in store.vectors().collect()} == {8}


# -- trees and graphs


def test_name_paths_with_overloads(spark):
    rows = [(1, ["A", "f"], [None, 0], "method", "a.py"), (2, ["A", "f"], [None, 1], "method", "a.py"), (3, ["f"], [None], "function", "b/c.py"), (4, ["A"], [None], "class", "a.py")]
    symbols = spark.createDataFrame(rows, "id int, names array<string>, overloads array<int>, kind string, path string")
    ids = lambda *a, **k: {r.id for r in tree.find(symbols, *a, **k).collect()}
    assert ids("f") == {1, 2, 3} and ids("f[1]") == {2} and ids("A/f[0]") == {1} and ids("/f") == {3} and ids("f", include=("method", "function"), exclude=("function",)) == {1, 2}
    assert ids("f", within="b") == {3} and ids("A", substring=True, exclude=("method",)) == {4} and ids("f[7]") == set()
    assert tree.find_unique(symbols, "A/f[1]").first().id == 2 and tree.find_unique(symbols, "f").first().id == 3  # its whole path
    for pattern, error in (("none", "no symbol"), ("A/f", "several")):
        with pytest.raises(ValueError, match=error):
            tree.find_unique(symbols, pattern)


def test_climbing(spark):
    parents = spark.createDataFrame([(k, k - 1 if k else None, k > 0) for k in range(12)], "id long, parent_id long, low boolean")
    start = spark.createDataFrame([("a", 11), ("b", 0), ("c", 99)], "key string, id long")
    assert {r.key: r.id for r in joins.climb(start, parents, F.col("low")).collect()} == {"a": 0, "b": 0, "c": 99}
    with pytest.raises(ValueError):
        joins.climb(start, spark.createDataFrame([(11, 10, True), (10, 11, True)], "id long, parent_id long, low boolean"), F.col("low"))


def test_chains_give_a_child_on_its_branch_once(spark):
    """alpha uses beta, beta uses alpha and gamma: alpha comes again as a leaf."""
    pad = "\n0\n0\n0\n0\n"
    text = f"alpha beta{pad}beta alpha gamma{pad}gamma"
    c = Corpus(spark.createDataFrame([(1, text, "en", "s", 30)], DOCS))
    got = {(r.depth, r.parent, r.name, r.trail.count(">")) for r in G.call_chain(c, "alpha", 4).collect()}
    assert got == {(0, None, "alpha", 0), (1, "alpha", "beta", 1), (2, "beta", "alpha", 2), (2, "beta", "gamma", 2)}
    assert [(r.depth, r.id) for r in G.call_chain(c, "nowhere").collect()] == [(0, None)]
    up = {(r.depth, r.parent, r.name) for r in G.change_impact(c, "gamma", 3).collect()}
    assert up == {(0, None, "gamma"), (1, "gamma", "beta"), (2, "beta", "alpha"), (3, "alpha", "beta")}
    near = {(r.of, r.side, r.name) for r in G.neighbourhood(c, "beta", 1).collect()}
    assert near == {("beta", "definition", "beta"), ("beta", "caller", "alpha"), ("beta", "callee", "alpha"), ("beta", "callee", "gamma")}


def test_code_context(spark):
    pad = "\n0\n0\n0\n0\n"
    docs = [(1, f"alpha beta{pad}beta alpha gamma{pad}gamma", "en", "s", 30), (2, f"check alpha{pad}gamma", "en", "tests", 9)]
    c = Corpus(spark.createDataFrame(docs, DOCS))
    (hit,) = [r for r in G.code_context(c, "alpha", limit=1, body_lines=3).collect()]
    assert hit.name == "alpha" and hit.truncated and "lines omitted" in hit.code
    assert [x.name for x in hit.called_by] == ["beta"] and [x.name for x in hit.tests] == ["check"] and [x.name for x in hit.calls] == ["beta"]
    gamma = G.code_context(c, "gamma", limit=1).first()
    assert [(x.name, x.speculative) for x in gamma.called_by] == [("beta", False)] and "tests" not in G.code_context(c, "gamma", limit=1, tests=False).columns


def test_type_hierarchy(spark):
    rows = [("Base", "class", "a", 1, "class Base:"), ("Own", "class", "b", 1, "class Own(Base, list):"), ("Sub", "struct", "c", 1, "struct Sub : public Own"), ("own", "function", "d", 1, "def own(Own)"), ("Base", "class", "z", 5, "class Base(Own):")]
    types = spark.createDataFrame(rows, "name string, kind string, path string, start_line int, signature string")
    assert {(r.side, r.name, r.path) for r in G.type_hierarchy(types, "Own").collect()} == {("item", "Own", "b"), ("super", "Base", "z"), ("sub", "Sub", "c"), ("sub", "Base", "z")}
    assert G.type_hierarchy(types, "None").count() == 0


def test_nested_groups_and_health(spark):
    rows = spark.createDataFrame([("a", 'q"1', 1), ("a", "b]:", 2), (None, "c", 3)], "x string, y string, v int").select("x", "y", F.struct("v").alias("item"))
    assert A.nested(rows, ["x", "y"], "item").first().grouped == '{"a":{"b]:":[2],"q\\\\"1":[1]},"unknown":{"c":[3]}}'.replace("\\\\", "\\")
    assert A.nested(rows, ["x"], "item", collapse=False).first().grouped == '{"a":[{"v":1},{"v":2}],"unknown":[{"v":3}]}'
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert tuple(A.health(ids, ids.limit(0)).first()) == (2, 0, 2, False, "embed,backfill") and A.health(ids, ids, "model-1", dirty=2).first().advice == "sync"


def test_blocks_beyond_one_pass(spark):
    blocks = spark.createDataFrame([(k, f"text number {k}.") for k in range(50)], "item_id long, text string")
    bodies = spark.createDataFrame([(f"p{k}", f"before text number {k % 25}. after") for k in range(100)], "path string, body string")
    assert {r.item_id: r.n for r in scan.containing(blocks, bodies, pass_chars=100).collect()} == dict.fromkeys(range(25), 4)


def test_renaming(spark):
    notes = spark.createDataFrame([("n", "mem:a/b and a/b, mem:a/bc, xmem:a/b"), ("m", None)], "name string, text string")
    assert [tuple(r) for r in references.renamed(notes, "a/b", "c$1").collect()] == [("n", "mem:c$1 and a/b, mem:a/bc, xmem:a/b", 1)]
    assert references.renamed(notes, "a/b", "c", marked_only=False).first().n == 2


# -- streams and runs


def test_a_stream_upserts_and_deletes(spark, tmp_path):
    schema = "user_id long, event_id long, gone boolean"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    at = f"file://{tmp_path}/snapshots"

    def run():
        incremental.stream_upsert(incremental.file_changes(spark, f"{tmp_path}/in", schema), at, "user_id", "event_id", "gone", parts=4).awaitTermination()
        return sorted((r.user_id, r.event_id) for r in incremental.newest_snapshot(spark, at, spark.createDataFrame([], schema).schema, "gone").collect())

    write([(k, k, False) for k in range(20)])
    assert run() == [(k, k) for k in range(20)]
    write([(3, 100, True), (4, 100, False), (5, 1, False), (50, 1, False)])
    want = sorted([(k, k) for k in range(20) if k not in (3, 4)] + [(4, 100), (50, 1)])
    assert run() == want
    write([(3, 50, False)])  # late: the key stays deleted
    assert run() == want
    (tmp_path / "snapshots" / "manifest" / "epoch=9").mkdir()  # a manifest that was never finished doesn't count
    assert run() == want


def test_runs_and_watchers(spark, tmp_path):
    with runs.track("r", "index") as outer:
        outer.set_phase("embedding", total=10)
        with runs.track("r", "nested") as inner:
            assert inner is outer
            inner.advance(4)
        shown = runs.current("r").snapshot()
        assert shown["percent"] == 40.0 and shown["running"] and shown["eta_s"] is not None
    assert runs.current("r").snapshot()["phase"] == "done"
    with pytest.raises(KeyError), runs.track("r", "again"):
        raise KeyError("x")
    assert runs.current("r").error.startswith("KeyError")
    made = []

    def start(name):
        made.append(name)
        return spark.readStream.format("rate").load().writeStream.format("noop").queryName(name).option("checkpointLocation", str(tmp_path / "w")).start()

    assert runs.start_watcher(spark, "/f", start)["running"] and runs.start_watcher(spark, "/f/", start)["running"] and len(made) == 1
    assert not runs.stop_watcher(spark, "/f")["running"] and not runs.watcher_status(spark, "/f")["running"]


def test_events_are_given_once(spark, tmp_path):
    from quillmark.streaming import events as V

    rows = [(k, k != 7, "reindex", "p", k == 2, "two" if k == 2 else None) for k in range(10)]
    log = spark.createDataFrame(rows, "event_id long, finished boolean, action string, project string, failed boolean, detail string")
    at = f"file://{tmp_path}/seen"
    first = V.take_unseen(log, at, "a", keep=8)
    assert [r.event_id for r in first] == [2, 3, 4, 5, 6] and V.take_unseen(log, at, "a", keep=8) == []
    assert [r.event_id for r in V.take_unseen(log.withColumn("finished", F.lit(True)), at, "a")] == [7, 8, 9]
    assert len(V.take_unseen(log, at, "b")) == 7 and V.notice([]) == ""
    assert "  - reindex on p (FAILED) - two" in V.notice(first)


def test_tools_by_name(spark):
    from quillmark.plans import tools

    c = Corpus(spark.createDataFrame([(1, "alpha beta\n0\n0\n0\n0\nbeta gamma", "en", "s", 9), (2, "alpha beta\n0\n0\n0\n0\nbeta gamma", "en", "tests", 9)], DOCS))
    assert {r.path for r in tools.call(c, "search_code", query="alpha", exclude_tests=True).collect()} == {"s/en/doc_1.txt"}
    assert tools.call(c, "get_dependents", name="beta").count() == 2 and tools.call(c, "search_regex", pattern="^beta").count() == 2
    groups = tools.call(c, "find_duplicate_code", min_lines=1).collect()
    assert sorted(len(g.members) for g in groups) == [2, 2] and all(g.min_similarity == 1.0 for g in groups)
    assert {"get_call_chain", "get_code_context"} <= set(tools.describe()) and "name" in tools.describe()["get_dependents"][0]
    with pytest.raises(ValueError):
        tools.call(c, "nothing")
    assert tools.shortened([lambda: "long text", lambda: "short"], 5) == "short" and "too long" in tools.shortened([lambda: "x" * 9], 5)


def test_similar_pairs_in_any_number_of_parts(spark):
    from quillmark.operators.clones import duplicate_groups, similar_pairs

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 8))
    x[30:45] = x[:15] + rng.normal(0, 0.05, (15, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(x[i] @ x[j]), 6) >= 0.8}
    for block in (7, 4096):
        assert {(r.a, r.b) for r in similar_pairs(v, 0.8, block).collect()} == want
    assert sum(r.size for r in duplicate_groups(v, 0.8, 100).collect()) == len({i for p in want for i in p})
