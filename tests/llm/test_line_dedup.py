import random

from pyspark.sql import functions as F

from quillmark.llm.common import cut
from quillmark.llm.line_dedup import apply, covered


def brute(rows):
    """rows: (id, text) in order of id; the kept texts."""
    first, out = {}, []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if first.setdefault(key, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out.append((None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def test_equals_brute_force(spark, docs_of):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", "long line of words"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    got = {r.doc_id: (r.kept_text, r.removed) for r in apply(docs_of(texts)).collect()}
    assert [got[i] for i in range(150)] == brute(list(enumerate(texts)))
    seen = {x for t in texts for x in t.split("\n")}
    assert seen == {x for t, _ in got.values() for x in t.split("\n")} | {""}  # no line's content is lost everywhere


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, "p\nq\nr\ns", "p\nq\nr\ns", "p\nq\nr\nt"], [*range(len(odd)), 900, 900, None])
    docs = docs.withColumn("__lost_at", F.lit(1)).withColumn("gone", F.lit(2))
    out = apply(docs)
    assert out.columns == [*docs.columns, "kept_text", "removed"]
    got = {(r.doc_id, r.text): (r.kept_text, r.removed) for r in out.collect()}
    assert got[(None, "p\nq\nr\nt")] == ("p\nq\nr\nt", 0)  # a null id comes first
    assert got[(900, "p\nq\nr\ns")] == ("s", 3) and out.where("doc_id = 900").count() == 2
    assert got[(0, None)] == (None, 0) and got[(9, odd[9])] == ("a\nb\nc", 3)
    assert apply(docs_of([])).count() == 0


def test_clashing_columns_stay(spark, docs_of):
    docs = docs_of(["p\nq\nr\ns", "p\nq\nr\nt"]).withColumns({"removed": F.lit("mine"), "Kept_Text": F.lit("also"), "_removed": F.lit(1)})
    out = apply(docs)
    assert out.columns == [*docs.columns, "_kept_text", "__removed"]
    got = {r.doc_id: (r.removed, r.Kept_Text, r._kept_text, r["__removed"]) for r in out.collect()}
    assert got == {0: ("mine", "also", "p\nq\nr\ns", 0), 1: ("mine", "also", "t", 3)}


def test_long_texts_equal_brute_force(spark, docs_of):
    """Words of bits between which others are empty, and two texts of many lines."""
    rng, far = random.Random(3), [f"own {k}" for k in range(400)]
    far[70:75] = far[5:10]
    far[330:340] = far[200:210]
    texts = ["\n".join(far), "\n".join(rng.choice("abcdefgh") for _ in range(3000)), "\n".join(f"line {k}" for k in range(30_000))]
    texts.append(texts[2] + "\nmore")
    got = {r.doc_id: (r.kept_text, r.removed) for r in apply(docs_of(texts)).collect()}
    assert [got[i] for i in range(4)] == brute(list(enumerate(texts)))


def test_a_hot_window_is_split(spark, docs_of):
    """The join back to the occurrences reads a shuffle on both sides, so that AQE can split a window's partition."""
    hot = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        docs = cut(docs_of([f"a {k}\nx\ny\nz\nb {k}" for k in range(20_000)]).repartition(12))
        lost = covered(docs)
        lost.collect()
        assert "skew=true" in lost._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_python_in_the_plan(spark, docs_of):
    plan = apply(docs_of(["a\nb\nc"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
