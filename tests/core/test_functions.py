import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.gitignore import ignored_by
from quillmark.functions.similarity import name_similarity, plain_text
from quillmark.operators import retrieval as R
from quillmark.operators.clones import components
from quillmark.operators.graph import change_impact
from quillmark.operators.tree import matches_name_path
from quillmark.plans.corpus import Corpus
from quillmark.streaming.incremental import burst_denials

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("pattern", "path", "hit"), [("auth.py", "src/auth.py", True), ("*.py", "src/auth.py", True), ("src/*", "src/auth.py", True), ("src/auth.py", "src/auth.py", True), ("*.[jt]s", "src/auth.py", False), ("other/*", "src/auth.py", False), ("[!s]*", "auth.py", True)])
def test_globs(spark, pattern, path, hit):
    assert value(spark, T.matches_glob(F.lit(path), pattern)) is hit


@pytest.mark.parametrize(("path", "hit"), [("tests/test_thing.py", True), ("spec/thing_spec.rb", True), ("a/b_test.go", True), ("x.spec.ts", True), ("latest.py", False), ("contest.py", False), ("attestation.py", False)])
def test_test_paths(spark, path, hit):
    assert value(spark, T.is_test(F.lit(path))) is hit


def test_braces():
    assert set(T.braces("a{b,c{d,e}}f")) == {"abf", "acdf", "acef"}
    assert T.braces("plain") == ["plain"]


@pytest.mark.parametrize(("rules", "path", "hit"), [(["*.log"], "a/b.log", True), (["*.log", "!keep.log"], "a/keep.log", False), (["/top/"], "top/x", True), (["/top/"], "in/top/x", False), (["a/**/z"], "a/b/c/z", True), (["**/d"], "d", True)])
def test_gitignore(spark, rules, path, hit):
    assert value(spark, ignored_by(F.lit(path), rules)) is hit


@pytest.mark.parametrize(("path", "pattern", "hit"), [(["A", "b"], "b", True), (["A", "b"], "A/b", True), (["A", "b"], "/b", False), (["A", "b"], "/A/b", True), (["X", "A", "b"], "A/b", True), (["A"], "A/b", False), (["A", "b"], "A/b[0]", False)])
def test_name_paths(spark, path, pattern, hit):
    assert value(spark, matches_name_path(F.array(*[F.lit(x) for x in path]), pattern)) is hit


def test_names_and_html():
    assert name_similarity("auth_v1", "auth_v2") == 1.0 and name_similarity("a/x", "b/y") < 0.5
    assert plain_text("<p>a &amp; b</p><p>c</p>") == "a & b c"


def test_blank_and_short_queries(spark):
    docs = spark.createDataFrame([(1, "alpha beta\ngamma", "en", "s", 16)], DOCS)
    c = Corpus(docs)
    assert R.hybrid(c, "  ").count() == 0 and R.substring(c, "ab").count() == 0
    assert {(r.name, r.source) for r in R.semantic(c, "gamma").collect()} == {("alpha", "vector")}
    assert {(r.name, r.source) for r in R.semantic(c, "doc").collect()} == {("doc_1", "bm25"), ("alpha", "bm25")}  # by its path
    hit = R.hybrid(c, "alpha").collect()
    assert {r.name for r in hit} == {"alpha", "doc_1"} and set(hit[0].sources.split(",")) <= set(R.FUSION)


def test_ownership_is_innermost_and_impact_has_its_root(spark):
    c = Corpus(spark.createDataFrame([(1, "alpha beta\nx\nx\nx\nx\nbeta alpha", "en", "s", 30)], DOCS))
    owners = {(r.name, r.line): r.owner_id for r in c.refs.collect()}
    assert owners[("beta", 6)] == 400_000_002 and owners[("alpha", 1)] == 400_000_001
    assert [(r.depth, r.name, r.id) for r in change_impact(c, "nowhere").collect()] == [(0, "nowhere", None)]
    assert (1, "beta") in {(r.depth, r.name) for r in change_impact(c, "alpha").collect()}


def test_components_of_a_chain(spark):
    got = {r.v: r.root for r in components(spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(21), 0) | {50: 50, 60: 50}


def test_bursts_deny_and_silence(spark):
    rows = [(k, 1, "search", 10 * k) for k in range(1, 5)] + [(9, 1, "purchase", 500), (10, 2, "search", 0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at long").withColumn("ts", F.timestamp_seconds("at"))
    assert {r.event_id for r in burst_denials(events).where("denied").collect()} == {3}


@pytest.mark.parametrize(("pattern", "before", "after"), [("b.c", 0, 0), ("b.c", 1, 1), ("^d$", 2, 0), ("a.*d", 0, 5), ("x*", 0, 0), ("e\\n", 1, 1)])
def test_matches_across_lines(spark, pattern, before, after):
    import re

    from quillmark.operators.scan import across_lines

    texts = {1: "a\nb\nc\nd\ne\n", 2: "", 3: None, 4: "b c\n\nb\nc", 5: "é b\nc é"}
    want = []
    for i, t in texts.items():
        for n, m in enumerate(re.finditer(pattern, t or "", re.MULTILINE | re.DOTALL) if t is not None else ()):
            a, b = t[: m.start()].count("\n"), t[: m.end()].count("\n")
            lines = t.splitlines()
            for k in range(max(0, a - before), min(len(lines) - 1, b + after) + 1):
                want.append((i, n, k, -1 if k < a else 1 if k > b else 0, lines[k]))
    got = across_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), pattern, before, after).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_added_blocks_pass_over_themselves(spark):
    from quillmark.operators.clones import clones_of_added

    body = "\n".join(f"one two three four word{k}" for k in range(5))
    corpus = Corpus(spark.createDataFrame([(1, body, "en", "s", 1), (2, body, "en", "s", 1), (3, "\n".join("quite other things here now" for _ in range(5)), "en", "s", 1)], DOCS))
    added = spark.createDataFrame([(1, "s/en/doc_1.txt", 1, 5, body), (2, "new.txt", 1, 5, body), (3, "new.txt", 1, 4, body), (4, "s/en/doc_3.txt", 3, 9, "quite other things here now"), (5, "new.txt", 9, 20, "nothing shared whatsoever at all")], "block long, path string, start_line int, end_line int, text string")
    for block in (1, 100):
        got = [tuple(r) for r in clones_of_added(corpus, added, block=block).collect()]
        assert got == [(1, 800_000_001, 1.0), (2, 400_000_001, 1.0)]
    assert clones_of_added(corpus, added.limit(0)).count() == 0


@pytest.mark.parametrize(("html", "closed", "any_"), [("<p>a&amp;&amp</p>", "a&&amp", "a&&"), ("a&am &quo &", "a&am &quo &", "a&am &quo &"), ("&copy;&copy 1 &#65;&#66 &lt;b&gt;", "©&copy 1 A&#66 <b>", "©© 1 AB <b>"), ("&amp;lt; &notit;", "&lt; &notit;", "&lt; ¬it;"), ("<a href='?x&amp=1'>k</a>", "k", "k")])
def test_cut_character_references(html, closed, any_):
    from quillmark.functions.similarity import plain_text

    assert plain_text(html, closed=True) == closed and plain_text(html) == any_
