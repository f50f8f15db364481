"""Unmarked mentions, near misses and marking, against brute force over every note and name."""

import re

import pytest

from quillmark.functions.similarity import SUFFIX, jaccard, name_similarity, words_of
from quillmark.operators import references as R

NAMES = ["auth/login", "grid-layout", "deployment_guide_v2", "deploymentGuide", "core", "api/core", "setup", "conventions", "repository_structure", "global/style-guide"]
NOTES = [
    ("auth/login", "See mem:setup and setup, not login; auth/login/more. Conventions, deployment-guide, deployment_guide"),
    ("setup", "setup auth/login (auth/login) xauth/login DeploymentGuide deployment_guide_old. core api/core"),
    ("conventions", "Conventions and grid-layout; layout-grid, Grid_Layout; repository repository_Structure_bak"),
    ("global/style-guide", "grid-layout"),
    ("empty", ""),
    ("none", None),
]
RUN = r"(?<!mem:)(?<![A-Za-z0-9_\-/])[A-Za-z0-9_\-/]+(?![A-Za-z0-9_\-/])"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(NOTES, "name string, text string").repartition(3), spark.createDataFrame([(n,) for n in NAMES * 2], "name string")


def runs(text):
    return re.findall(RUN, text or "")


@pytest.mark.parametrize(("a", "b", "score"), [("auth_v1", "auth_v2", 1), ("login", "auth/login", 1), ("auth/login", "auth/v2/login", 0.75), ("auth/login", "security/login", 0.5), ("auth", "authentication", 0.642857), ("foo", "for", 0), ("frontend/layout-subtleties", "backend/events-subtleties", 0)])
def test_name_similarity(a, b, score):
    assert name_similarity(a, b) == pytest.approx(score, abs=1e-6)


def test_unmarked(tables):
    want = set()
    for source, text in NOTES:
        for name in NAMES:
            n = runs(text).count(name)
            if n and name not in (source, source.split("/")[-1]) and name.split("/")[-1] != "core":
                want.add((source, name, n, "/" in name or len(name) >= 10))
    got = [tuple(r) for r in R.unmarked(*tables).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_near_misses(tables):
    normal = lambda s: re.sub(SUFFIX, "", s.lower())
    want = set()
    for source, text in NOTES:
        for token in {t for t in runs(text) if len(t) >= 10 and t not in NAMES}:
            best = (0, None)
            for name in sorted(n for n in NAMES if ("/" in n or len(n) >= 10) and n.split("/")[-1] != "core"):
                x, y, s = normal(token), normal(name), round(name_similarity(token, name), 6)
                if (x in y or y in x) and s >= 0.55 and jaccard(words_of(token), words_of(name)) >= 0.6 and s > best[0]:
                    best = (s, name)
            if best[1] and normal(best[1]) != normal(source):
                want.add((source, token, best[1], runs(text).count(token)))
    got = [tuple(r) for r in R.near_misses(*tables).collect()]
    assert len(want) >= 4 and len(got) == len(want) and set(got) == want


def test_auto_prefix(tables):
    got = {r.name: r for r in R.auto_prefix(*tables).collect()}
    assert set(got) == {"setup", "conventions"}
    assert got["setup"].text == "setup mem:auth/login (mem:auth/login) xauth/login DeploymentGuide deployment_guide_old. core api/core" and got["setup"].n == 2
    wide = {r.name: r.text for r in R.auto_prefix(*tables, flat=True, shared=True).collect()}
    assert wide["auth/login"].startswith("See mem:setup and mem:setup, not login; auth/login/more.") and wide["global/style-guide"] == "mem:grid-layout"


def test_empty_tables(tables):
    notes, names = tables
    for f in (R.unmarked, R.near_misses, R.auto_prefix):
        assert f(notes.limit(0), names).isEmpty() and f(notes, names.limit(0)).isEmpty()


def test_stale_references_and_their_targets(spark, tables):
    notes = [(n, f"see mem:{t}, mem:{t} and xmem:gone" if t else t) for n, t in (("a", "auth/log-in"), ("b", "deployment_guide"), ("c", "setup"), ("d", "zzz"), ("e", None))]
    got = {(r.source, r.name): r.targets for r in R.stale_report(spark.createDataFrame(notes, "name string, text string"), tables[1]).collect()}
    want = {}
    for source, missing in (("a", "auth/log-in"), ("b", "deployment_guide"), ("d", "zzz")):
        scored = sorted((-name_similarity(missing, n), n) for n in NAMES)
        want[source, missing] = [n for s, n in scored if -s >= 0.55][:3]
    assert got == want and got["b", "deployment_guide"]


@pytest.mark.parametrize("block", [1, 5000])
def test_targets_of_all_names_equal_brute_force(spark, tables, block):
    missing = ["gridLayout", "layout", "conventions_old", "style-guide", "repo_structure", "x", "api/core2", "auth/login/more"]
    got = {(r.name, r.target, r.score) for r in R.likely_targets(spark.createDataFrame([(m,) for m in missing], "name string"), tables[1], block=block).collect()}
    want = set()
    for m in missing:
        scored = sorted((-round(name_similarity(m, n), 6), n) for n in NAMES)
        want |= {(m, n, -s) for s, n in scored[:3] if -s >= 0.55}
    assert got == want and len(got) > 5


def test_no_missing_names(spark, tables):
    assert R.likely_targets(tables[1].limit(0), tables[1]).count() == 0


@pytest.mark.parametrize(("apart", "want"), [(False, {"a": ("n/x n/x,n/x mem:n/x", 4), "b": ("n/x\n", 1), "c": ("én/x\nn/x x/", 2)}), (True, {"a": ("n/x x,n/x mem:n/x", 3), "b": ("n/x\n", 1), "c": ("én/x\nx x/", 1)})])
def test_renamed_neighbours(spark, apart, want):
    """Of two mentions with one character between them both are renamed, or, as in the query's SQL, the first."""
    notes = spark.createDataFrame([("a", "x x,x mem:x"), ("b", "x\n"), ("c", "éx\nx x/"), ("d", "xx -x"), ("e", None)], "name string, text string")
    assert {r.name: (r.text, r.n) for r in R.renamed(notes, "x", "n/x", marked_only=False, apart=apart).collect()} == want
    assert {r.name: r.n for r in R.renamed(notes, "x", "n/x", apart=apart).collect()} == {"a": 1}


@pytest.mark.parametrize("k", [1, 3])
def test_bounded_search_loses_no_name(k):
    """Names of several words, folders, versions, long ones and other alphabets, in batches, against every pair."""
    import random

    from quillmark.functions.nearest import Names

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7)))
    names = ["", "_", "/", "a/", "É/ñandú", "ß-x", "x" * 200, "ab" * 90 + "_v2", "Core/API", "api_core_old", "aaaa-aaaaaaa"]
    names += ["".join(x for _ in range(rng.randint(1, 3)) for x in (word(), rng.choice("/_-"))) + word() + rng.choice(["", "", "_v3"]) for _ in range(150)]
    asked = [*names[:40], *(word() + word() for _ in range(30)), "x" * 190 + "y", "ab" * 100, "aaaaaaa-aaaa", "ñandú"]
    best = [[] for _ in asked]
    for lo in (0, 60, 120, 1000):
        Names(names[lo : lo + 60]).nearest(asked, k, 0.55, best) if lo < 120 else Names(names[120:] if lo == 120 else []).nearest(asked, k, 0.55, best)
    for a, top in zip(asked, best, strict=True):
        scored = sorted((-round(name_similarity(a, n), 6), n) for n in names)
        assert top == [x for x in scored if -x[0] >= 0.55][:k], a


def test_many_missing_names_take_little_time():
    import random
    import time

    from quillmark.functions.nearest import Names

    rng = random.Random(6)
    names = sorted({"".join(rng.choice("aeinrsthondl") for _ in range(rng.randint(4, 10))) + "tion" for _ in range(20_000)})
    asked, began = [n[1:] + "al" for n in names[::100]], time.process_time()
    best = [[] for _ in asked]
    Names(names).nearest(asked, 3, 0.55, best)
    took = time.process_time() - began
    began = time.process_time()
    for a, top in zip(asked[:1], best, strict=False):
        assert top == sorted((-round(name_similarity(a, n), 6), n) for n in names)[:3]
    assert took < 0.2 * len(asked) * (time.process_time() - began)
