"""Vocabularies beyond a broadcast's bound, and index arrays of many classes."""

import pytest

from wingbeat.operators import labels, tables


def test_id_to_code_large_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(tables.join_sized, "__defaults__", (50,))
    df = spark.range(100).withColumnRenamed("id", "predicted")
    vocab = spark.range(100).selectExpr("id AS label_id", "concat('c', id) AS code")
    out = labels.id_to_code(df, vocab)
    assert {r.predicted: r.code for r in out.collect()} == {i: f"c{i}" for i in range(100)}


def test_many_classes(spark):
    n = 300_000
    model = spark.range(n).selectExpr("CAST(id AS INT) AS label_id", "concat('c', id) AS code")
    data = spark.range(n).selectExpr("CAST(id AS INT) AS label_id", f"concat('c', {n + 5} - id) AS code")
    df = spark.range(1).selectExpr(f"transform(sequence(id, id + {n - 1}), x -> CAST(x AS DOUBLE)) AS logits")
    out = labels.restrict_logits(df, model, data).first().logits
    assert len(out) == n and out[:8] == [-10.0] * 6 + [n - 1.0, n - 2.0] and out[-1] == 6.0
    with pytest.raises(ValueError):
        labels.class_mask(df, model, data)


def test_class_mask_with_labels(spark):
    vocab = lambda *c: spark.createDataFrame(list(enumerate(c)), "label_id int, code string")
    df = spark.createDataFrame([([1.0, 2.0, None], [1, 0, 1]), ([4.0, 5.0, 6.0], [7])], "logits array<double>, labels array<int>")
    out = labels.class_mask(df, vocab("a", "b", "c"), vocab("c", "a")).collect()
    assert [(r.logits, r.labels) for r in out] == [([None, 1.0], [1, 1]), ([6.0, 4.0], [7])]
