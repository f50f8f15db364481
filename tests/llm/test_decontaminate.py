import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm.common import table
from quillmark.llm.decontaminate import Matcher, drop_contaminated, matches, myers, normal

ITEMS = "item_id long, text string"


def within(pattern, text):
    """Least edit distance of pattern to a part of text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        prev, row[0] = row[:], 0
        for i, p in enumerate(pattern, 1):
            row[i] = min(prev[i] + 1, row[i - 1] + 1, prev[i - 1] + (p != ch))
        best = min(best, row[-1])
    return best


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        got = myers(p, t, len(p))
        assert (got[0] if got else None) == within(p, t)


def test_search_equals_brute_force(words):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng.randint(1, 30), 100 + k))) for k in range(12)]
    texts = []
    for k in range(24):
        t = normal(items[k % 12][1])
        edits = rng.randint(0, 2 * max(1, Matcher.budget(t)))
        for _ in range(edits):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "q", t[at] + "q"]) + t[at + 1 :]
        texts.append(" ".join(words(10, k)) + "  " + t.upper() + "\n" + " ".join(words(6, 500 + k)))
    m = Matcher(tuple(items))
    for t in texts:
        n = normal(t)
        want = set()
        for i, x in items:
            p = normal(x)
            if len(p) < 24:
                if f" {p} " in f" {n} ":
                    want.add((i, 0))
            elif (d := within(p, n)) <= Matcher.budget(p):
                want.add((i, d))
        assert {(i, d) for i, d, _ in m.search(t)} == want


def test_items_that_repeat_phrases_equal_brute_force(words):
    """A piece that recurs in its item is first met at an alignment beyond the occurrence's own."""
    phrase = "the cat sat down the cat sat down the cat sat down"
    rng, items = random.Random(6), [(0, phrase)]
    for k in range(1, 12):
        items.append((k, " ".join(" ".join(words(rng.randint(1, 3), k)) for _ in range(rng.randint(4, 8)))))
    texts = ["thx cat sat dowx the cat sat down the cat sat down"]
    for k in range(120):
        t = items[k % 12][1]
        for _ in range(rng.randint(1, Matcher.budget(t) + 1)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "q", t[at] + "q"]) + t[at + 1 :]
        texts.append(t)
    texts = [f"{' '.join(words(4, 900 + k))} {t} {' '.join(words(4, 700 + k))}" for k, t in enumerate(texts)]
    m = Matcher(tuple(items))
    for t in texts:
        want = {(i, d) for i, x in items if (d := within(normal(x), normal(t))) <= Matcher.budget(normal(x))}
        assert {(i, d) for i, d, _ in m.search(t)} == want


def test_refrains_equal_brute_force_at_every_edit_count():
    """Long items whose phrases come again and again, with every number of edits within the budget and one more."""
    rng = random.Random(9)
    vocabulary = "the cat sat down and then up it went over old hill".split()
    for refrain in ("the cat sat down ", "and then up it went over the old hill ", "ab"):
        item = normal("".join(refrain + (" ".join(rng.choice(vocabulary) for _ in range(2)) + " ") * (k % 2) for k in range(260 // len(refrain))))
        m = Matcher(((0, item),))
        for edits in range(Matcher.budget(item) + 2):
            t = list(item)
            for at in rng.sample(range(len(t)), edits):
                t[at] = rng.choice(["", "q", t[at] + "q"])
            text = normal(f"{refrain} before {''.join(t)} {refrain * 2} after")
            d = within(item, text)
            assert [x[1] for x in m.search(text)] == ([d] if d <= Matcher.budget(item) else []), (refrain, edits)


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_blocks_give_the_same_rows(spark, docs_of, words, odd, block):
    items = [(k, " ".join(words(12, k))) for k in range(6)] + [(7, None), (8, " "), (9, " ".join(words(12, 0))), (None, " ".join(words(12, 1)))]
    bench = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("clash"))
    docs = docs_of([*odd, *(f"before {' '.join(words(12, k))} after" for k in range(3)), f"x {' '.join(words(12, 2))}"], [*range(len(odd)), 100, 101, None, 101])
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in matches(docs, bench, block).collect())
    assert got == sorted([("100", "0", 0), ("100", "9", 0), ("101", "1", 0), ("101", "None", 0), ("None", "2", 0), ("101", "2", 0)])
    kept = drop_contaminated(docs, bench, block)
    assert kept.count() == len(odd) and kept.columns == docs.columns


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEMS)
    assert matches(docs_of(["a b"]), none).count() == 0 and matches(docs_of([]), none).count() == 0
    assert drop_contaminated(docs_of(["a b"]), none).count() == 1


def test_whole_tables_against_containment(spark, small):
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    texts, items = {r.doc_id: normal(r.text) for r in docs.collect()}, {r.item_id: normal(r.text) for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in matches(docs, bench).where("distance = 0").collect()}
    assert got == exact
