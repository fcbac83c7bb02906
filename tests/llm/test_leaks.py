"""Benchmark items planted in documents: all copies are found, and nothing else."""

import random

import numpy as np
import pyarrow as pa

from wingbeat.llm import decontaminate, tokens

ITEM = "item_id long, text string"
DOC = "doc_id long, text string"


def _pairs(spark, docs, items):
    out = decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    return sorted((r.doc_id, r.item_id) for r in out)


def _text(rng, n, words):
    return [rng.choice(["the", "of", "a", "is", "to", "in"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]


def test_item_in_a_third_of_the_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(_text(rng, 30, words)) + ". " + " ".join(_text(rng, 6, words)) + ".") for i in range(20)]
    items.append((20, "the of a is to in the a of to is in"))  # no content word
    docs, want = [], []
    for i in range(210):
        text = _text(rng, 120, words)
        if i % 3 == 0:
            text[60:60] = items[0][1].split()
            want.append((i, 0))
        if i in (1, 4):
            text[40:40] = items[i][1].split()
            want.append((i, i))
        if i == 7:
            text[50:50] = items[20][1].split()
            want.append((i, 20))
        docs.append((i, " ".join(text)))
    assert _pairs(spark, docs, items) == sorted(want)


def test_long_item(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(_text(rng, 294 if i == 0 else 30, words)) + ". " + " ".join(_text(rng, 6, words)) + ".") for i in range(20)]
    docs, want = [], []
    for i in range(60):
        text = _text(rng, 900 if i % 2 else 90, words)
        if i in (3, 8, 20):
            copy = items[0][1].split()
            if i == 20:  # a tenth of the words replaced
                copy = [w if k % 10 else "other" for k, w in enumerate(copy)]
            text[50:50] = copy
            want.append((i, 0))
        docs.append((i, " ".join(text)))
    assert _pairs(spark, docs, items) == want


def test_space_is_fitted_on_all_passages(spark):
    """The distributed product against one dense matrix, and its singular vectors against numpy's."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(_text(rng, rng.choice((0, 20, 100)), words)) for i in range(50)] + [None]
    weight, none = np.random.default_rng(1).random(decontaminate.TERMS).astype(np.float32), np.zeros(0, np.uint64)
    sketch = decontaminate.Sketch(80)
    got, passages = decontaminate.gram(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), sketch, weight, none)
    rows = []
    for t in texts:
        w = (t or "").split()
        for i in range(0, len(w), 32):
            (chunk,) = tokens.chunks(pa.array([" ".join(w[i : i + 32])]))
            at = decontaminate.term(decontaminate.word_hashes(chunk))
            row = np.bincount(at, weights=weight[at], minlength=decontaminate.TERMS)
            rows.append(row / np.sqrt((weight[at].astype(float) ** 2).sum()))
    a = np.array(rows)
    assert passages == len(rows)
    assert np.allclose(got, a.T @ (a @ sketch.dense()), rtol=1e-4, atol=1e-4)
    space = decontaminate.latent_space(got, sketch, 40).astype(float)
    _, values, right = np.linalg.svd(a, full_matrices=False)
    assert ((a @ space) ** 2).sum() > 0.98 * (values[:40] ** 2).sum()


def test_paraphrases(spark):
    """Items with a fifth of the question's words replaced and others put in between: at least 0.9 are found, and no others."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(_text(rng, 36, words)) + ". " + " ".join(_text(rng, 6, words)) + ".") for i in range(80)]
    docs, want = [], set()
    for i in range(160):
        text = _text(rng, 150, words)
        if i < 80:
            copy = items[i][1].split()
            for k in range(36):
                if rng.random() < 0.2:
                    copy[k] = rng.choice(words)
            for _ in range(4):
                copy.insert(rng.randrange(30), rng.choice(words))
            text[70:70] = copy
            want.add((i, i))
        docs.append((i, " ".join(text)))
    got = set(_pairs(spark, docs, items))
    assert got <= want and len(got) >= 0.9 * len(want)


def test_verbatim_items_of_any_length(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(6000)]
    items = [(i, " ".join(_text(rng, n, words)) + ".") for i, n in enumerate((100, 250, 400, 2000))]
    docs = [(i, " ".join([*_text(rng, 300, words), *(items[i][1].split() if i < 4 else []), *_text(rng, 50, words)])) for i in range(40)]
    assert _pairs(spark, docs, items) == [(i, i) for i in range(4)]


def test_odd_rows(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    item = " ".join(_text(rng, 40, words)) + "."
    docs = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, " ".join(_text(rng, 30000, words)) + " " + item)] + [(i, " ".join(_text(rng, 60, words))) for i in range(10, 30)]
    items = [(7, item), (7, item), (None, item), (8, None), (9, "")]
    df = spark.createDataFrame([(*d, 0.5, "k") for d in docs], DOC + ", cosine double, item_id string")
    bench = spark.createDataFrame([(*x, "z") for x in items], ITEM + ", doc_id string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()]
    assert {d for d, _ in got} == {1, None, 4} and {i for _, i in got} == {7, None}
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, 2, 3, *range(10, 30)}
    assert decontaminate.leaks(df.limit(0), bench).count() == decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_blocks_and_scans(spark, monkeypatch):
    """Items of many blocks, of which few are kept ready, in one scan and in several: the same as in one block."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(_text(rng, 36, words)) + ". " + " ".join(_text(rng, 6, words)) + ".") for i in range(60)] + [(60, "is of the a to in the of is a to the")]
    docs = [(i, " ".join([*_text(rng, 80, words), *(items[i % 61][1].split() if i % 2 else []), *_text(rng, 40, words)])) for i in range(240)]
    docs, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)

    def pairs(**how):
        return sorted((r.doc_id, r.item_id, round(r.lcs, 6)) for r in decontaminate.leaks(docs, bench, **how).collect())

    whole = pairs()
    assert [p[:2] for p in whole] == [(i, i % 61) for i in range(1, 240, 2)]
    assert [p[:2] for p in pairs(scan_bytes=4000)] == [p[:2] for p in whole]  # other words are projected: other cosines
    cut = decontaminate._blocks
    monkeypatch.setattr(decontaminate, "_blocks", lambda rows, block: cut(rows, 4))  # more than a worker keeps
    assert pairs() == whole
