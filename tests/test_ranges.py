"""Nulls, narrow ranges and plans of splits, metrics, sampling and augmentation."""

import random

import numpy as np
from pyspark.sql import functions as F

from wingbeat.operators import augment, balance, batches, cluster, metrics, prefix, splits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def segments(spark, n=30, nulls=4):
    names = [f"R_S0{i % 2}_2024010{i // 10 + 1}_06_{i % 10}_{i % 10 + 5}" for i in range(n)] + [None] * nulls
    return spark.createDataFrame([(x, i) for i, x in enumerate(names)], "filepath string, no int")


def test_rows_without_a_file_stay(spark):
    df = segments(spark)
    for out, times in ((splits.split_by_file(df, 12, 0.3), 1), (splits.kfold_by_file(df, 3), 3), (splits.kfold_by_site(df, 3), 3), (splits.tail_split(df, 0.3), 1), (splits.tail_split(df, 0.3, by_site=True), 1)):
        assert out.count() == 34 * times and out.where("filepath is null").count() == 4 * times
        assert out.where("filepath is null").select(*[c for c in out.columns if c in ("fold", "split")]).distinct().count() == times
    first = splits.kfold_by_file(df, 3).where("filepath is null and fold = 0").select("split").distinct().collect()
    assert [r.split for r in first] == ["test"]  # before all others


def test_file_splits_in_many_ranges(spark, monkeypatch):
    df = segments(spark, 60)
    want = [sorted(map(str, f(df).collect())) for f in (lambda d: splits.kfold_by_file(d, 4), lambda d: splits.tail_split(d, 0.2, by_site=True))]
    for name, value in {"RANGE_ROWS": 2, "SAMPLES": 1, "PARTS": 50}.items():
        monkeypatch.setattr(prefix, name, value)
    assert [sorted(map(str, f(df).collect())) for f in (lambda d: splits.kfold_by_file(d, 4), lambda d: splits.tail_split(d, 0.2, by_site=True))] == want
    assert "NestedLoop" not in plan(splits.kfold_by_file(df, 4)) and "Cartesian" not in plan(splits.kfold_by_file(df, 4))
    rows, bucket = prefix.in_name_ranges(df.select("filepath").distinct(), "filepath")
    assert rows.select(bucket.alias("b")).distinct().count() > 10


def test_null_labels_are_levelled(spark):
    df = spark.createDataFrame([(None, "a", "1"), (None, "a", "2"), (1, "a", "3")], "label int, filepath string, event_id string")
    assert balance.level_events(df, None, 5).count() == 3


def test_a_narrow_class_is_cut(spark, monkeypatch):
    """One class between two cuts of the others, one of equal scores, one null: all as without ranges."""
    rng = random.Random(3)
    rows = [(c, s, int(rng.random() < 0.3)) for c, draw in ((0, lambda: rng.random()), (1, lambda: 0.5 + rng.random() / 1e6), (2, lambda: 0.25), (None, lambda: rng.random())) for s in [draw() for _ in range(300)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, class int, score double, target int")
    functions = (metrics.average_precision, metrics.auroc, metrics.map_micro, metrics.metric_set)
    rounded = lambda out: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in out.collect())
    want = [rounded(f(df)) for f in functions]
    monkeypatch.setattr(prefix, "RANGE_ROWS", 20)
    assert [rounded(f(df)) for f in functions] == want
    ranges, bucket = prefix.in_ranges(metrics.by_score(df), "score", ["class"])
    sizes = ranges.groupBy("class", bucket.alias("b")).count().groupBy("class").agg(F.max("count").alias("most"), F.count("b").alias("n")).collect()
    assert {r["class"]: r.n > 50 for r in sizes} == {0: True, 1: True, 2: False, None: True} and max(r.most for r in sizes) < 20


def test_draws_follow_the_rows(spark):
    """Ten draws of many rows: only their buckets are sorted."""
    df = spark.range(200_000).select("id", F.when(F.col("id") == 7, 1e6).otherwise(1.0).alias("w"))
    out = balance.weighted_sample(df, "w", 10, "id", 3)
    got = [r.id for r in out.collect()]
    assert len(got) == 10 and got.count(7) >= 6
    assert balance.weighted_sample(df.limit(0), "w", 10, "id").count() == 0


def test_robust_quantiles(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(r, float(x)) for r, n in (("a", 211), ("b", 4), (None, 37), ("one", 1)) for x in [rng.choice([rng.gauss(0, 1), 3.0, 3.0]) for _ in range(n)]] + [("a", None)]
    df = spark.createDataFrame(rows, "recording string, x double")
    for limit in (50_000, 10):
        monkeypatch.setattr(prefix, "RANGE_ROWS", limit)
        got = cluster._order_statistics(df.where("x is not null").select("recording", F.lit("x").alias("g"), "x"), [0.25, 0.5, 0.75]).collect()
        for r in got:
            want = np.percentile([x for n, x in rows if n == r.recording and x is not None], [25, 50, 75])
            assert np.allclose(r.q, want)
    assert cluster.scale_features(df, [], ["x"], "robust").count() == len(rows)


def test_only_picked_waveforms_move(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("samples"), F.array(F.lit(1.0)).alias("labels"))
    noise = spark.createDataFrame([(10 * i, [float(i)] * 2) for i in range(7)] + [(None, [9.0, 9.0])], "clip int, samples array<double>")
    out = augment.inject_nocall(df, noise, 0.3, seed=2, number="clip")
    rows = {r.row_id: r for r in out.collect()}
    changed = [r for r in rows.values() if r.labels == [0.0]]
    assert len(rows) == 300 and 60 < len(changed) < 120 and {r.samples[0] for r in changed} == {float(i) for i in range(7)}
    assert all(r.samples == [1.0, float(i)] for i, r in rows.items() if r.labels == [1.0])
    assert augment.inject_nocall(df, noise.limit(0), 0.3, number="clip").where("labels[0] = 1").count() == 300
    noisy = {r.row_id: r.samples for r in augment.add_noise(df, noise, 0.5, seed=2, number="clip").collect()}
    assert len(noisy) == 300 and sum(s != [1.0, float(i)] for i, s in noisy.items()) > 90


def test_table_function(spark):
    df = spark.createDataFrame([("a", [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]], [1, 0, 0], 5), ("b", [[0.0, 1.0]], [-1], 6), ("c", [[0.0, 1.0], [2.0, 3.0]], [-1, -1], 7), ("d", [], [], 8)], "filepath string, detected_events array<array<double>>, event_cluster array<int>, `a b` int")
    got = sorted((r.filepath, r["a b"], r.detected_events, r.event_cluster) for r in batches.event_rows(df).collect())
    assert got == [("a", 5, [1.0, 2.0], [0]), ("a", 5, [2.0, 3.0], [0]), ("b", 6, [0.0, 1.0], [-1]), ("c", 7, [0.0, 5.0], []), ("d", 8, [0.0, 5.0], [])]
    assert batches.event_rows(df, False).where("filepath = 'a'").count() == 3
    assert "Join" not in plan(batches.event_rows(df)) and "Python" not in plan(batches.event_rows(df))


def test_long_clips(spark):
    """Clips of 160,000 samples in frames; the spectrum of a tone peaks in its band."""
    df = spark.range(3).select(F.col("id").alias("row_id"), F.expr("transform(sequence(0, 159999), t -> CAST(sin(2 * pi() * 4000 * t / 32000) AS FLOAT))").alias("samples")).unionByName(spark.createDataFrame([(8, None), (9, [])], "row_id long, samples array<float>"))
    got = {r.row_id: r.mel for r in batches.mel_features(df).collect()}
    assert got[8] is None and got[9] is None
    mel = np.array(got[0])
    assert mel.shape == (128, 501)
    bands = batches.mel_bands(32000, 1024, 128)
    centre = [first + int(np.argmax(w)) if len(w) else -1 for first, w in bands]
    assert abs(centre[int(mel[:, 250].argmax())] * 32000 / 1024 - 4000) < 150


def test_ranks_move_rows_once(spark):
    """The sums of the buckets before are sent to the rows: only the window shuffles them."""
    from wingbeat.operators import splits

    plan = splits.ranked(spark.range(100).withColumnRenamed("id", "key"), "key", 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
