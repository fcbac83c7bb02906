"""Null and repeated ids: only near copies and rows equal in id and text go."""

import random

from wingbeat.llm import jaccard


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (3, b), (3, c), (3, c), (4, c), (5, a), (5, d), (None, e), (None, d), (None, None), (6, None)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (3, b), (3, c), (5, d), (None, e), (None, d), (None, None), (6, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
