import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillmark.llm import queries
from quillmark.llm.common import cut, table


def test_stages_keep_columns_and_rows(spark, small):
    sf = small
    docs, columns = table(spark, sf, "documents"), None
    kept = {}
    for name, stage in P.STAGES:
        columns = docs.columns
        before = docs
        docs = cut(stage(spark, docs, sf))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes
        assert 0 < docs.count() <= before.count()
    assert kept["quality rules"] >= kept["line dedup"] >= kept["n-gram Jaccard join"] >= kept["benchmark decontamination"] >= kept["mixing"]
    assert {r.doc_id for r in P.run(spark, sf).collect()} == kept["mixing"]


def test_stages_equal_brute_force(spark, small):
    """Each stage against a plain version over what the stage before it gave."""
    from test_decontaminate import within
    from test_jaccard_join import brute as near
    from test_line_dedup import brute as dedup
    from test_quality_rules import brute as counts

    from quillmark.llm import mixing
    from quillmark.llm.decontaminate import Matcher, normal
    from quillmark.llm.quality_rules import REJECT_BELOW, QualityRules

    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    given = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    model, after = QualityRules.fit(docs, labels), {}
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, small))
        after[name] = {r.doc_id: r for r in docs.collect()}
    texts = lambda name: {k: r.text for k, r in after[name].items()}

    scores = model.score(pa.array([t for _, t in given]))["probability"]
    want = {}
    for (i, t), p in zip(given, scores, strict=True):
        n, _, _, _, again = counts(t)
        if n >= 10 and 100 * again <= 20 * n and p >= REJECT_BELOW:
            want[i] = t
    assert texts("quality rules") == want

    rows = sorted(want.items())
    want = {i: t for (i, _), (t, gone) in zip(rows, dedup(rows), strict=True) if not gone or t.split()}
    assert texts("line dedup") == want
    assert all(r.n_chars == len(r.text) for r in after["line dedup"].values())

    rows = sorted(want.items())
    want = {i: t for k, ((i, t), (root, _)) in enumerate(zip(rows, near([t for _, t in rows]), strict=True)) if root == k}
    got = texts("n-gram Jaccard join")
    assert set(want) <= set(got) and len(got) - len(want) <= 0.01 * len(rows)  # the join's recall

    items = [normal(r.text) for r in table(spark, small, "benchmark").collect()]
    left = {}
    for i, t in got.items():
        x = normal(t)
        bound = lambda p: f" {p} " in f" {x} " if len(p) < 24 else p in x or within_budget(p, x)

        def within_budget(p, x):
            k = Matcher.budget(p)
            pieces = [p[len(p) * j // (k + 1) : len(p) * (j + 1) // (k + 1)] for j in range(k + 1)]
            return any(q in x for q in pieces) and within(p, x) <= k

        if not any(bound(p) for p in items if p):
            left[i] = t
    assert texts("benchmark decontamination") == left

    import hashlib
    import math

    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in left.items()}
    rows = after["benchmark decontamination"]
    cell = {i: (rows[i].source, rows[i].lang, "brief" if n < mixing.BRIEF else "article" if n < mixing.LONG else "long") for i, n in tokens.items()}
    total, weight, targets = sum(tokens.values()), dict.fromkeys(cell.values(), 1.0), []
    for j, m in enumerate(mixing.MARGINS):
        share = {}
        for i, n in tokens.items():
            share[cell[i][j]] = share.get(cell[i][j], 0) + n / total
        powered = {k: v ** mixing.TEMPER[m] if v else 0.0 for k, v in share.items()}
        targets.append({k: v / sum(powered.values()) * total for k, v in powered.items()})
    for _ in range(mixing.SWEEPS):
        for j in range(3):
            now = {}
            for i, n in tokens.items():
                now[cell[i][j]] = now.get(cell[i][j], 0) + n * weight[cell[i]]
            weight = {c: w * (targets[j][c[j]] / now[c[j]] if now[c[j]] else 1.0) for c, w in weight.items()}
    copies = {}
    for i in tokens:
        mean = mixing.FRACTION * weight[cell[i]]
        u = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
        if (c := math.floor(mean) + (u < mean - math.floor(mean))) > 0:
            copies[i] = c
    assert {i: r.copies for i, r in after["mixing"].items()} == copies


def test_odd_documents(spark, small, docs_of, odd, words):
    """Nulls in any column, blank and long texts, repeated rows and ids, and columns with the names that stages use."""
    a, b, c, d = (" ".join(words(60, k)) for k in range(70, 74))
    ids = [*range(len(odd)), 50, 50, 51, 51, None, None, 52, 53]
    docs = docs_of([*odd, a, a, b, c, d, d, f"{a} more", None], ids)
    docs = docs.withColumns({"lang": F.when(F.col("doc_id") != 51, F.col("lang")), "source": F.when(F.col("doc_id") != 52, F.col("source")), "n_chars": F.when(F.col("doc_id") != 53, F.col("n_chars")), "removed": F.lit("mine"), "copies": F.lit(-1), "__gone": F.lit(0), "tokens": F.lit("t")})
    kept = {}
    for name, stage in P.STAGES:
        before, docs = docs.columns, cut(stage(spark, docs, small))
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert docs.columns[: len(before)] == before and docs.where("removed <> 'mine' or copies <> -1 or tokens <> 't'").count() == 0
        if name != P.STAGES[-1][0]:
            assert docs.columns == before
    ordinary = sorted([(50, a), (50, a), (51, b), (51, c), (None, d), (None, d), (52, f"{a} more")], key=str)
    assert [x for x in kept["quality rules"] if x in ordinary] == ordinary and all(x in ordinary or x[1] in odd for x in kept["quality rules"])
    assert not any(t is None or not t.split() for _, t in kept["quality rules"])
    once = sorted([(50, a), (51, b), (51, c), (None, d), (None, d)], key=str)
    assert [x for x in kept["n-gram Jaccard join"] if x[1] in (a, b, c, d, f"{a} more")] == once
    assert set(kept["mixing"]) <= set(kept["benchmark decontamination"])


def test_empty_documents(spark, small, docs_of):
    docs = docs_of([])
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, small))
    assert docs.count() == 0


def test_each_operator_has_one_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_a_written_table_finds_its_folders_made(spark, tmp_path):
    """So Hadoop starts no chmod for them on the driver; the write leaves nothing but its files."""
    from quillmark.llm.common import made

    at = made(f"file://{tmp_path}/a/b")
    assert (tmp_path / "a/b/_temporary/0/_temporary").is_dir()
    spark.range(5).write.mode("append").parquet(at)
    assert spark.read.parquet(at).count() == 5 and not (tmp_path / "a/b/_temporary").exists()
    assert made("viewfs://store/x") == "viewfs://store/x" and cut(spark.range(0), "none").count() == 0
