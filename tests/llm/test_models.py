import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import language_id, quality_cnn, toxicity, vec
from quillmark.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = score.rank()
    a, b = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - a * (a + 1) / 2) / (a * b)


def held(ids, modulus, remainder):
    return np.array([zlib.crc32(str(i).encode()) % modulus == remainder for i in ids])


def test_factorization_machine_learns_a_pair():
    """Neither term is toxic by itself; both together are."""
    rng = np.random.default_rng(0)
    docs, y = [], []
    for k in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.unique(np.array([*([11] if a else []), *([22] if b else []), *rng.integers(100, 120, 3)], vec.U)))
        y.append(float(a and b))
    old, toxicity.MIN_Z = toxicity.MIN_Z, 2.0
    try:
        m = toxicity.FactorizationMachine.fit_rows(docs, np.array(y), {0: 1, 1: 1}, rounds=400)
    finally:
        toxicity.MIN_Z = old
    i, j = np.searchsorted(m.keys, np.array([11, 22], vec.U))
    assert m.v[i] @ m.v[j] > 0.5


def test_pair_of_terms_without_an_association_of_their_own():
    """At the constants of production: both terms are in 30 % of the toxic and of the clean documents, together only in toxic ones."""

    def draw(seed, n):
        rng, docs = np.random.default_rng(seed), []
        for k in range(n):
            u = rng.random()
            own = ([11, 22] if u < 0.3 else []) if k % 2 else [11] if u < 0.3 else [22] if u < 0.6 else []
            docs.append(np.unique(np.array([*own, *rng.integers(100, 1500, 80)], vec.U)))
        return docs, np.arange(n) % 2.0

    m = toxicity.FactorizationMachine.fit_rows(*draw(0, 1200), {0: 1, 1: 1})
    assert m.constant is None and {11, 22} <= set(m.keys.tolist())
    docs, _ = draw(1, 600)
    raw, _ = m._raw(*m._cells(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])), len(docs))
    has = np.array([(11 in d, 22 in d) for d in docs])
    assert raw[has.all(1)].min() > raw[has.any(1) & ~has.all(1)].max() + 2


def test_pair_screen_equals_plain_statistics(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.4) * 1.0
    x = rng.random((400, 30)) < rng.uniform(0.1, 0.6, 30)
    x[:, 3] = np.where(y == 1, x[:, 20], x[:, 3])
    x[:, 8] = np.where((y == 0) & (rng.random(400) < 0.8), ~x[:, 29], x[:, 8])
    z = np.zeros((30, 30))
    for i in range(30):
        for j in range(30):
            parts = []
            for c in (0, 1):
                a, b = x[y == c, i] * 1.0, x[y == c, j] * 1.0
                e = (a - a.mean()) * (b - b.mean())
                parts.append((e.mean(), max(e.var(), a.var() * b.var()) / len(a)))
            z[i, j] = 0 if i == j else (parts[1][0] - parts[0][0]) / np.sqrt(parts[0][1] + parts[1][1])
    col, row = np.nonzero(x.T)
    want = (np.abs(z) >= toxicity.PAIR_Z).any(1)
    assert want.sum() >= 4 and (toxicity.paired(row, col, 30, y) == want).all()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents").withColumn("score", F.lit("clash")), table(spark, SF, "labels")
    m = toxicity.FactorizationMachine.fit(docs, labels)
    got = m.transform(docs).join(labels, "doc_id").toPandas()
    h = got[held(got.doc_id, 4, 2)]
    assert auc(h.score, h.toxic) > 0.8 and got.score.between(0, 1).all()
    assert (h.score[h.toxic == 0] >= 0.3).mean() < 0.05


def test_network_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    m = quality_cnn.ByteNetwork.fit(docs, labels)
    got = m.transform(docs).join(labels, "doc_id").toPandas()
    h = got[held(got.doc_id, 3, 1)]
    assert auc(h.score, h.quality) > 0.9


def test_filters_learn_from_the_inside_of_texts():
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    y = np.arange(60) % 2.0
    ends = [(letters(256), letters(256)) for _ in y]
    one, two = ([a + letters(2000) + b for a, b in ends] for _ in range(2))
    fit = lambda texts: quality_cnn.ByteNetwork.fit_texts(texts, y, {0: 30, 1: 30}, epochs=2)
    assert np.array_equal(fit(one).table, fit(one).table)
    assert not np.allclose(fit(one).table, fit(two).table)


def test_network_pooling_equals_plain_loops():
    rng = np.random.default_rng(1)
    table_ = rng.normal(0, 1, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32)
    bias = rng.normal(0, 1, quality_cnn.FILTERS).astype(np.float32)
    texts = [b"", b"a", b"x" * 127, bytes(rng.integers(32, 126, 128)), bytes(rng.integers(32, 126, 700))]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality_cnn.pooled(np.frombuffer(b"".join(texts), np.uint8), offs, table_, bias)
    for t, row in zip(texts, got, strict=True):
        data = t + b"\0" * 2 * quality_cnn.WIDTH
        act = np.array([[max(0, sum(table_[k][data[p + k]][f] for k in range(quality_cnn.WIDTH)) + bias[f]) for f in range(quality_cnn.FILTERS)] for p in range(max(1, len(t)))])
        n, h = len(act), quality_cnn.HALF
        halves = max(1, -(-len(t) // h))
        tops = [act[k * h : min(n, (k + 2) * h)].max(0) for k in range(max(1, halves - 1))]
        want = np.concatenate([np.mean(tops, 0), np.max(tops, 0), np.min(tops, 0)])
        assert np.allclose(row, want, atol=1e-4)


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    m = language_id.OutputCodes.fit(docs)
    got = m.transform(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    h = got[held(got.doc_id, 4, 2)]
    assert (h.lang == h.lang_pred).mean() > 0.97
    names, scores, unsure = m.score(pa.array([None, "", "1234 !!", "the and of", "\n"]))
    assert names[:3] == ["und"] * 3 and names[3] != "und" and names[4] == "und" and scores[0] == 0 and unsure[0]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 12, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n).astype(int)
    assert len({tuple(r) for r in code}) == n
    far = (code.shape[1] - code @ code.T) // 2 + code.shape[1] * np.eye(n, dtype=int)
    assert far.min() >= (1 if n < 4 else 3)


def test_odd_texts_and_tables_without_labels(spark, docs_of, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([*odd, *odd], [*range(len(odd)), *range(len(odd) - 1), None])
    for m in (toxicity.FactorizationMachine.fit(docs, none), quality_cnn.ByteNetwork.fit(docs, none)):
        rows = m.transform(docs).collect()
        assert len(rows) == 2 * len(odd) and len({r.score for r in rows}) == 1
    one = language_id.OutputCodes.fit(docs)
    assert {r.lang_pred for r in one.transform(docs).collect()} == {"en", "und"}
    assert {r.lang_pred for r in language_id.OutputCodes.fit(docs_of([])).transform(docs).collect()} == {"und"}


def plain_sigmoid(z):
    import math

    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def test_machine_scores_equal_plain_loops(spark, odd):
    """b + sum of weights + sum over all pairs of the factors' products, for each text by itself."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    m = toxicity.FactorizationMachine.fit(docs, labels)
    texts = [*odd, *(r.text for r in docs.orderBy("doc_id").limit(60).collect())]
    got, known = m.score(pa.array(texts)), {int(k): i for i, k in enumerate(m.keys)}
    for t, score in zip(texts, got, strict=True):
        found = set()
        for ch in vec.chunks(pa.array([t], pa.string())):
            found = {known[int(h)] for h in toxicity.terms(ch.c, ch.offs)[0] if int(h) in known}
        z = m.b + sum(m.w[i] for i in found) + sum(float(m.v[i] @ m.v[j]) for i in found for j in found if i < j)
        assert abs(score - plain_sigmoid(m.slope * max(-12.0, min(12.0, z)) + m.shift)) < 1e-6


def test_language_scores_equal_plain_loops(spark):
    import math

    docs = table(spark, SF, "documents")
    m = language_id.OutputCodes.fit(docs)
    texts = [t for r in docs.orderBy("doc_id").limit(60).collect() if (t := (r.text or "")[:3000])]
    names, scores, _ = m.score(pa.array(texts))
    lower = vec.tables()[0]
    for t, name, score in zip(texts, names, scores, strict=True):
        z = [float(b) for b in m.b]
        c = [int(lower[ord(x)]) for x in t]
        for n in (1, 2, 3):
            count = max(0, len(c) - n + 1)
            for p in range(count):
                x = 0x2545F491 * n & 0xFFFFFFFF
                for k in range(n):
                    x = (x ^ c[p + k]) * 0x9E3779B1 & 0xFFFFFFFF
                    x ^= x >> 15
                column = (x * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - language_id.BITS)
                z = [a + language_id.SCALE * float(w) / count for a, w in zip(z, m.w[column], strict=True)]
        loss = [sum(math.log1p(math.exp(-a * int(bit))) * float(q) for a, bit, q in zip(z, word, m.trust, strict=True)) for word in m.code]
        assert any(ch.isalpha() for ch in t) is (name != "und")
        if name != "und":
            assert name == m.languages[loss.index(min(loss))] and abs(score - 1 / sum(math.exp(min(loss) - x) for x in loss)) < 1e-4


def test_network_scores_equal_plain_loops(spark):
    """Filters at every byte, half-chunks, pooling and the logistic layer, one position at a time."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    m = quality_cnn.ByteNetwork.fit(docs, labels)
    texts = [r.text for r in docs.where("length(text) < 900").orderBy("doc_id").limit(12).collect()]
    for t, score in zip(texts, m.score(pa.array(texts)), strict=True):
        raw = t.encode()
        data, h = raw + b"\0" * 2 * quality_cnn.WIDTH, quality_cnn.HALF
        act = [[max(0.0, sum(float(m.table[k][data[p + k]][f]) for k in range(quality_cnn.WIDTH)) + float(m.bias[f])) for f in range(quality_cnn.FILTERS)] for p in range(max(1, len(raw)))]
        halves = max(1, -(-len(raw) // h))
        tops = [[max(col) for col in zip(*act[k * h : (k + 2) * h], strict=True)] for k in range(max(1, halves - 1))]
        feats = [f(col) for f in (lambda x: sum(x) / len(x), max, min) for col in zip(*tops, strict=True)]
        z = m.b + sum((x - float(a)) / float(s) * float(w) for x, a, s, w in zip(feats, m.mean, m.scale, m.w, strict=True))
        assert abs(score - plain_sigmoid(m.slope * z + m.shift)) < 1e-3


def test_training_chunks_cover_whole_texts(monkeypatch):
    """Every byte of every text that trains the filters is in some epoch's chunks."""
    seen: dict[int, set] = {}
    original = quality_cnn.np.frombuffer

    def spy(buffer, kind=float, *rest, **more):
        out = original(buffer, kind, *rest, **more)
        if kind is np.uint8:
            seen.setdefault(0, set()).update(x.tobytes() for x in out.reshape(-1, 2 * quality_cnn.HALF + quality_cnn.WIDTH - 1)) if len(out) % (2 * quality_cnn.HALF + quality_cnn.WIDTH - 1) == 0 else None
        return out

    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 256, 700, 5000, 20_000) for _ in range(4)]
    monkeypatch.setattr(quality_cnn.np, "frombuffer", spy)
    quality_cnn.ByteNetwork.fit_texts(texts, np.arange(24) % 2.0, {0: 1, 1: 1}, epochs=5)
    monkeypatch.undo()
    size = 2 * quality_cnn.HALF
    for k, t in enumerate(texts):
        if k % 5:
            assert all(t[a : a + size].ljust(size + quality_cnn.WIDTH - 1, b"\0") in seen[0] for a in [*range(0, len(t) - size, size), max(0, len(t) - size)])


def test_any_number_of_languages(spark, docs_of):
    """More languages than any fixed bound: none is refused."""
    from quillmark.llm.common import stratified

    rows = spark.range(6000).selectExpr("id as doc_id", "concat('l', id % 1500) as lang")
    sample, counts = stratified(rows, "doc_id", "lang", 2)
    assert len(counts) == 1500 and set(counts.values()) == {4} and 2000 < sample.count() < 4000 and sample.columns == rows.columns


def test_odd_texts_score_alike_in_any_batch(odd):
    rng = np.random.default_rng(3)
    m = quality_cnn.ByteNetwork(rng.normal(0, 1, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), np.zeros(quality_cnn.FILTERS, np.float32), 0.0, 1.0, rng.normal(0, 0.01, 3 * quality_cnn.FILTERS))
    together = m.score(pa.array([*odd, *odd[::-1]]))
    alone = np.concatenate([m.score(pa.array([t], pa.string())) for t in [*odd, *odd[::-1]]])
    assert np.allclose(together, alone, atol=1e-5)
