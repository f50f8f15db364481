import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import mixing
from quillmark.llm.common import table


def test_margins_are_met(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix(docs).toPandas()
    out["w"] = out.tokens * out.weight
    total = out.tokens.sum()
    for m in mixing.MARGINS:
        share = out.groupby(m).tokens.sum() / total
        target = share ** mixing.TEMPER[m]
        target = target / target.sum()
        assert np.allclose(out.groupby(m).w.sum() / total, target, atol=0.01), m
    assert abs((out.tokens * out.p).sum() - mixing.FRACTION * total) < 1e-6 * total
    assert abs(out.tokens[out.kept].sum() - mixing.FRACTION * total) < 0.15 * total


def test_drawn_copies_meet_the_margins(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    all_, out = mixing.mix(docs).toPandas(), mixing.draw(docs).toPandas()
    assert (out.copies >= 1).all() and out.doc_id.is_unique and out.copies.max() > 1
    whole = all_.tokens.sum()
    assert abs((out.tokens * out.copies).sum() - mixing.FRACTION * whole) < 0.05 * whole
    drawn = (out.tokens * out.copies).groupby(out.topic).sum() / (out.tokens * out.copies).sum()
    assert np.allclose(drawn[["article", "brief", "long"]], 1 / 3, atol=0.03)
    mean = mixing.FRACTION * all_.weight
    of = dict(zip(out.doc_id, out.copies, strict=True))
    got = all_.doc_id.map(of).fillna(0)
    assert (got >= np.floor(mean)).all() and (got <= np.floor(mean) + 1).all()
    for m in mixing.MARGINS:
        target = (all_.groupby(m).tokens.sum() / whole) ** mixing.TEMPER[m]
        share = (all_.tokens * mean).groupby(all_[m]).sum() / (all_.tokens * mean).sum()
        assert np.allclose(share, target / target.sum(), atol=0.01), m


def test_the_pipeline_s_last_stage_meets_the_topics(spark):
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = corpus_pipeline.mix_sources(spark, docs, "").toPandas()
    tokens = out.tokens * out.get("copies", 1)
    assert np.allclose(tokens.groupby(out.topic).sum() / tokens.sum(), 1 / 3, atol=0.03)


def test_rate_keeps_heavy_cells_whole():
    t, w = np.array([10.0, 10.0, 100.0]), np.array([50.0, 1.0, 0.1])
    r = mixing.rate(t, w)
    assert abs((t * np.minimum(1, r * w)).sum() - 60) < 1e-9 and r * w[0] >= 1


def test_many_cells_go_the_distributed_way(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for fraction in (0.1, 0.5, 0.95, 1.0):
        a = {r.doc_id: r for r in mixing.mix(docs, fraction=fraction).collect()}
        b = {r.doc_id: r for r in mixing.mix(docs, fraction=fraction, max_cells=3).collect()}
        assert len(a) == len(b) and all(abs(a[k].weight - b[k].weight) < 1e-9 * a[k].weight and abs(a[k].p - b[k].p) < 1e-9 and a[k].kept == b[k].kept for k in a)


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, "a b"], [*range(len(odd)), None]).withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))).withColumn("kept", F.lit("clash"))
    out = mixing.mix(docs)
    assert out.count() == len(odd) + 1 and out.columns == [*docs.columns, "tokens", "topic", "weight", "p", "_kept"]
    assert out.where("p is null or weight is null or _kept is null").count() == 0
    assert mixing.mix(docs_of([])).count() == 0
    blank = mixing.mix(docs_of([None, "", " "])).collect()
    assert len(blank) == 3 and {r.weight for r in blank} == {1.0}
