"""Hand-made cases of the operators."""

import pytest
from pyspark.sql import functions as F

from wingbeat.functions import arrays, keys
from wingbeat.operators import balance, events, labels, metrics, splits, stats

REC = "filepath string, detected_events array<array<double>>, event_cluster array<int>, length double"


def recs(spark, *clusters):
    return spark.createDataFrame([(f"f{i}", [[float(j), j + 1.0] for j in range(len(c))], list(c), 10.0) for i, c in enumerate(clusters)], REC)


def test_events(spark):
    rows = events.explode_events(recs(spark, [1, 0, 0, 1], [-1], [-1, -1], [])).collect()
    got = {}
    for r in rows:
        got.setdefault(r.filepath, []).append((r.detected_events, r.event_cluster))
    assert sorted(got["f0"]) == [([1.0, 2.0], [0]), ([2.0, 3.0], [0])]
    assert got["f1"] == [([0.0, 1.0], [-1])]
    assert got["f2"] == got["f3"] == [([0.0, 5.0], [])]


def test_gaps_and_clamp(spark):
    df = spark.createDataFrame([("f", [[1.0, 2.0], [4.0, 6.0]], 10.0)], "filepath string, detected_events array<array<double>>, length double")
    assert events.nocall_gaps(df).first().gaps == [[0, 1], [2, 4], [6, 10]]
    df = spark.createDataFrame([(2.0, 2.5), (2.0, 9.0)], "s double, e double")
    assert [(r.new_start, r.new_end) for r in events.clamp_interval(df).collect()] == [(2, 3), (2, 7)]
    df = spark.createDataFrame([("a", 1.0, 2.0, 60.0), ("b", 58.0, 59.0, 60.0), ("c", 1.0, 2.0, 4.0)], "k string, s double, e double, duration double")
    cut = {r.k: r.cut_start for r in events.shift_window(df, "k").collect()}
    assert 0 <= cut["a"] <= 3 and 52 <= cut["b"] <= 55 and cut["c"] == 0


@pytest.mark.parametrize(("sizes", "class_limit", "event_limit", "cap"), [([8, 3], None, 5, 3), ([8, 3], 10, 5, 8), ([6, 4, 1], 5, 4, 4), ([7], 5, 5, 7)])
def test_level_caps(spark, sizes, class_limit, event_limit, cap):
    df = spark.createDataFrame([(0, f"f{i}", f"{i}-{j}") for i, n in enumerate(sizes) for j in range(n)], "label int, filepath string, event_id string")
    assert balance.level_caps(df, class_limit, event_limit).first().cap == cap
    assert balance.level_events(df, class_limit, event_limit).count() == sum(min(n, cap) for n in sizes)


def test_counts_and_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (3,)], "label int")
    assert [r.n for r in stats.count_labels(df).orderBy("label").collect()] == [2, 0, 0, 1]
    w = stats.class_weights(spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "label int, n long")).orderBy("label").collect()
    assert [round(r.weight, 6) for r in w] == [2, 0, 1.154701]


def test_keys_and_splits(spark):
    p = spark.createDataFrame([("REC_S01_20240101_060000_0_5",)], "p string").select(keys.file_key(F.col("p")), keys.site_key(F.col("p")), keys.day_key(F.col("p"))).first()
    assert tuple(p) == ("REC_S01_20240101_060000", "S01", "20240101")
    df = spark.createDataFrame([(f"R_S01_20240101_0{i}_{j}_{j + 5}",) for i in range(3) for j in range(10)], "filepath string")
    test = [r.filepath for r in splits.split_by_file(df, 12, 1 / 3).where("split = 'test'").collect()]
    assert len(test) == 10 and all("_01_" in x for x in test)
    assert splits.train_test_split(df, 0.25, "filepath").where("split = 'test'").count() == 8


def test_metrics(spark):
    long = spark.createDataFrame([(1, 0, 0.9, 1), (2, 0, 0.8, 0), (3, 0, 0.7, 1), (1, 1, 0.5, 1), (2, 1, 0.5, 0)], "row_id long, class int, score double, target int")
    assert {r["class"]: round(r.ap, 6) for r in metrics.average_precision(long).collect()} == {0: 0.833333, 1: 0.5}
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "pred int, true int")
    assert round(metrics.balanced_accuracy(df, 3).first()[0], 6) == 0.833333
    assert metrics.balanced_accuracy(df, 3, axis="true").first()[0] == 0.75
    wide = spark.createDataFrame([(1, [0.4, 0.1], [0, 0])], "row_id long, scores array<double>, targets array<int>")
    assert metrics.topk_accuracy(wide, 1, True).first()[0] == 1


def test_labels_and_arrays(spark):
    vocab = lambda *c: spark.createDataFrame(list(enumerate(c)), "label_id int, code string")
    df = spark.createDataFrame([([1.0, 2.0],)], "logits array<double>")
    assert labels.restrict_logits(df, vocab("a", "b"), vocab("b", "c")).first().logits == [2, -10]
    with pytest.raises(ValueError):
        labels.class_mask(df, vocab("a", "b"), vocab("b", "c"))
    one = spark.createDataFrame([([0.0, 5.0, 10.0], [1, 1, 0], [1.0, 1e-12])], "a array<double>, m array<int>, p array<double>")
    got = one.select(arrays.min_max_scale(F.col("a"), F.col("m")), arrays.power_to_db(F.col("p"))).first()
    assert [round(x, 5) for x in got[0]] == [-1, 1, 0] and got[1] == [0, -80]
    w = spark.createDataFrame([("k", [1.0, 4.0]), ("k", [3.0, 2.0])], "key string, logits array<double>")
    assert events.merge_windows(w, "key").first().logits == [3, 4]
