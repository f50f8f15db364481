import random

import numpy as np
import pytest

from quillmark.llm import token_counts as K
from quillmark.llm.common import scratch, table


def test_equals_direct_counts(spark, small):
    ranks, _, _ = K.encoder()
    enc, _ = K._encoding(ranks)
    docs = table(spark, small, "documents")
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(docs, block=777).collect()} == want


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, "<|endoftext|>", "a b c"], [*range(len(odd)), None, 5])
    got = K.count_tokens(docs, block=64).collect()
    assert len(got) == len(odd) + 2 and sum(r.n_tokens == 0 for r in got) == 2
    assert len([r for r in got if r.doc_id == 5]) == 2 and next(r for r in got if r.doc_id is None).n_tokens > 1
    assert K.count_tokens(docs_of([])).count() == 0


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_scan_round_trip(spark, block):
    """Separators at blocks' bounds, documents longer than many blocks, and a file without a last separator."""
    rng, folder, want = random.Random(block), scratch(spark, "ids"), {}
    at = folder.removeprefix("file://")
    import os

    os.makedirs(at)
    for f in range(4):
        sizes = [rng.choice((0, 0, 1, 2, 7, 40)) for _ in range(12)]
        ids = [x for n in sizes for x in [*[5] * n, 9]]
        if f == 3:
            ids, sizes = ids + [5, 5], [*sizes, 2]
        np.array(ids, "<u2").tofile(f"{at}/{f}.ids")
        want |= {(f"{f}.ids", k): n for k, n in enumerate(sizes)}
    got = K.scan(K.blocks(spark, folder, "<u2", block), folder, 9, "<u2").collect()
    assert {(r.file, r.ordinal): r.n_tokens for r in got} == want and len(got) == len(want)
