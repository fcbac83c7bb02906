"""Repeats against a plain loop on spliced texts, and how many rows they shuffle."""

import random

from pyspark.sql import functions as F

from wingbeat.llm import common, repeats

TEXT = "doc_id long, text string"


def plain(rows, window=50):
    first = {}
    for i, t in sorted(rows):
        w = t.split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = set()
    for i, t in rows:
        w = t.split()
        gone = {j + k for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for k in range(window)}
        out.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def spliced(n, seed):
    """Texts of cuts from few sources, of which many share symbols but differ before or after; with long runs of few words."""
    rng = random.Random(seed)
    sources = [[f"w{rng.randrange(300)}" for _ in range(400)] for _ in range(4)] + [[rng.choice("xxxxxxxy") for _ in range(300)], ["x"] * 200]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            s, a = rng.choice(sources), rng.randrange(180)
            words += s[a : a + rng.randrange(20, 120)] + [f"u{rng.randrange(9)}"] * rng.randrange(3)
        rows.append((rng.randrange(n) if i % 9 == 0 else i, " ".join(words)))
    return rows


def test_spliced_texts(spark, monkeypatch):
    rows = spliced(150, 4)
    want = plain(rows)
    df = spark.createDataFrame(rows, TEXT).repartition(5)
    for bits in (repeats.SIEVE, 8):
        monkeypatch.setattr(repeats, "SIEVE", bits)
        assert {tuple(r) for r in repeats.without_repeats(df).collect()} == want


def shuffled(spark, run):
    """Rows that stages of a run write for shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_rows_shuffled(spark, monkeypatch):
    """Passages that many documents share aren't shuffled window by window, whatever may be broadcast; twice the documents, at most twice the rows."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(1)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(20)]
    found = []
    for n in (100, 200):
        rows = [(i, f"a{i} {passages[i % 20]} b{i}") for i in range(n)]
        df = common.staged(spark.createDataFrame(rows, TEXT).repartition(n // 10), "docs")
        found.append(shuffled(spark, lambda df=df: repeats.without_repeats(df).agg(F.sum("n_removed")).collect()))
    assert 100 < found[0] < 0.4 * 100 * 253 and found[1] < 2.2 * found[0], found
