import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm.common import table
from quillmark.llm.quality_rules import QualityRules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_equal_brute_force(odd, words):
    texts = [*odd, *(" ".join(words(60, k)) + "\n" + " ".join(words(9, k % 3)) + "\n" + " ".join(words(9, k % 3)) for k in range(30)), "1 2 3 4 5 1 2 3 4 5 1", "a a a a a a"]
    got = QualityRules().score(pa.array(texts))
    for i, t in enumerate(texts):
        assert tuple(int(got[n][i]) for n in NAMES) == brute(t), (i, (t or "")[:40])
        n, _, _, _, again = brute(t)
        assert got["base_failed"][i] == (n < 10 or 100 * again > 20 * n)


def test_counts_over_the_tables_texts(spark, small):
    texts = [r.text for r in table(spark, small, "documents").select("text").collect()]
    got = QualityRules().score(pa.array(texts))
    assert [tuple(int(got[n][i]) for n in NAMES) for i in range(len(texts))] == [brute(t) for t in texts]


def test_empty_batch_and_empty_tables(spark, docs_of):
    assert len(QualityRules().score(pa.array([], pa.string()))["kept"]) == 0
    empty, labels = docs_of([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = QualityRules.fit(empty, labels)
    assert model.w is None and model.transform(empty).count() == 0 and model.filter(empty).count() == 0


def test_model_rejects_junk_and_filter_keeps_all_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").withColumn("probability", F.lit("clash"))
    labels = table(spark, sf, "labels")
    model = QualityRules.fit(docs, labels)
    got = model.transform(docs).join(labels, "doc_id").toPandas()
    assert (got.kept[got.quality == 0]).mean() < 0.1
    fine = got[(got.quality == 1) & ~got.base_failed]
    assert fine.kept.mean() > 0.98
    kept = model.filter(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in model.transform(docs).where("kept").collect()}


def test_one_class_gives_no_verdict(spark, docs_of, words):
    docs = docs_of([" ".join(words(40, k)) for k in range(6)])
    labels = spark.createDataFrame([(k, 1, None) for k in range(6)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    model = QualityRules.fit(docs, labels)
    assert model.w is None and all(r.kept for r in model.transform(docs).collect())


@pytest.mark.parametrize("text", ["é b\tc\x0bd\x0ce\rf", "a b", "a b"])
def test_only_ascii_white_space_splits(text):
    assert int(QualityRules().score(pa.array([text]))["n_words"][0]) == brute(text)[0]
    assert np.isfinite(QualityRules().score(pa.array([text]))["probability"][0])


def test_verdicts_equal_plain_loops(spark, small, odd):
    """kept: no base rule fails, and the sum over the document's own hashed n-grams passes the threshold."""
    import math

    from quillmark.llm import vec
    from quillmark.llm.quality_rules import REJECT_BELOW, _sparse

    docs = table(spark, small, "documents")
    model = QualityRules.fit(docs, table(spark, small, "labels"))
    texts = [*odd, *(r.text for r in docs.collect())]
    got = model.score(pa.array(texts))
    for i, t in enumerate(texts):
        n, _, _, _, again = brute(t)
        (ch,) = vec.chunks(pa.array([t], pa.string()))
        ((col, val),) = _sparse(ch.c, ch.offs)
        p = 1 / (1 + math.exp(-(model.slope * (model.b + sum(float(model.w[c]) * float(v) for c, v in zip(col, val, strict=True))) + model.shift)))
        assert abs(got["probability"][i] - p) < 1e-4
        if abs(p - REJECT_BELOW) > 1e-4:
            assert bool(got["kept"][i]) == (n >= 10 and 100 * again <= 20 * n and p >= REJECT_BELOW)


@pytest.mark.parametrize("tail", [None, "", "x", "ab", "abc", "abcd"])
def test_short_texts_at_the_end_of_a_chunk(words, tail):
    """Texts with fewer code points than an n-gram have none, also where no other text follows."""
    rng = np.random.default_rng(3)
    model = QualityRules(rng.normal(0, 0.1, 1 << 18).astype(np.float32), 0.2)
    texts = [" ".join(words(30, 1)), tail, tail]
    alone = [model.score(pa.array([t, " ".join(words(30, 2))], pa.string()))["probability"][0] for t in texts]
    assert np.allclose(model.score(pa.array(texts, pa.string()))["probability"], alone, atol=1e-9)


def test_training_leaves_the_features_off_the_driver(spark, small, monkeypatch):
    """The model is learned in a task; the driver gets one row of it."""
    DataFrame = type(spark.range(0))
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("features on the driver"))
    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append((self.columns, rows := collect(self))) or rows)
    model = QualityRules.fit(table(spark, small, "documents"), table(spark, small, "labels"))
    assert len(model.w) == 1 << 18 and [(c, len(r)) for c, r in got if c[0] != "label"] == [(["w", "b", "slope", "shift"], 1)]
