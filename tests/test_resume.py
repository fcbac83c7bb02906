"""What survives a failure: prepared folders, streams; states that merge."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from wingbeat.operators import metrics
from wingbeat.sources import io
from wingbeat.streaming import streams


@pytest.fixture
def rows(spark):
    return spark.range(40).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))


def test_a_half_written_folder_is_written_again(spark, rows, tmp_path):
    root, cfg = f"file://{tmp_path}", {"a": 1}
    path = io.write_prepared(rows, root, "x", 1, cfg)
    at = path.removeprefix("file://")
    assert io.read_prepared(spark, path, "test").count() == 10
    before = sorted(os.listdir(at))
    assert io.write_prepared(rows.limit(0), root, "x", 1, cfg) == path and sorted(os.listdir(at)) == before  # the same configuration is kept
    os.remove(f"{at}/_SUCCESS")  # as a write leaves it that ended early
    shutil.rmtree(f"{at}/split=test")
    assert io.write_prepared(rows, root, "x", 1, cfg) == path
    assert io.read_prepared(spark, path, "test").count() == 10 and io.read_prepared(spark, path, "train").count() == 30
    for name in os.listdir(at):
        if name.startswith(io.MARK):
            os.remove(f"{at}/{name}")
    with pytest.raises(FileNotFoundError):
        io.read_prepared(spark, path, "test")
    io.write_prepared(rows.where("id < 8"), root, "x", 1, cfg)
    assert io.read_prepared(spark, path, "test").count() == 2
    assert [n for n in os.listdir(tmp_path) if n.startswith(".x")] == []
    assert io.write_prepared(rows, root, "x", 1, {"a": 2}) != path


def test_writers_at_once(spark, rows, tmp_path, monkeypatch):
    """Another writer commits between the first look and the move: its table stays, and this one's folder goes."""
    root, cfg, looks = f"file://{tmp_path}", {"a": 1}, []
    path = io.write_prepared(rows.where("id < 8"), root, "x", 1, cfg)
    real = io._committed
    monkeypatch.setattr(io, "_committed", lambda *a: real(*a) if looks else bool(looks.append(1)))
    assert io.write_prepared(rows, root, "x", 1, cfg) == path
    assert io.read_prepared(spark, path, "test").count() == 2
    assert [n for n in os.listdir(tmp_path) if n.startswith(".x")] == []


def test_an_empty_prepared_table(spark, rows, tmp_path):
    path = io.write_prepared(rows.limit(0), f"file://{tmp_path}", "x", 1, {})
    assert io.read_prepared(spark, path, "test").columns == ["id", "split"] and io.read_prepared(spark, path, "test").count() == 0


def predictions(spark, n=120):
    score = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 50
    return spark.range(n).select(F.array(*[score(i) for i in range(4)]).alias("scores"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(i + 9)), F.lit(3)) == 0).cast("int") for i in range(4)]).alias("targets"))


def values(df):
    return {r.name: round(r.value, 9) for r in df.collect()}


def test_merged_states_equal_the_whole(spark):
    rows = predictions(spark)
    whole = values(metrics.finish_metrics(metrics.metric_state(rows)))
    assert set(whole) == set(metrics.METRICS)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("scores"), F.lit(3)))
    states = [metrics.metric_state(parts.where(F.col("part") == i)) for i in range(3)]
    merged = metrics.merge_states(states[0].unionByName(states[1]).unionByName(states[2]))
    assert values(metrics.finish_metrics(merged)) == whole
    twice = metrics.merge_states(merged.unionByName(metrics.metric_state(rows.limit(0))))
    assert values(metrics.finish_metrics(twice)) == whole
    assert whole["T3Accuracy"] == round(metrics.topk_accuracy(rows, 3).first()[0], 9)


def test_own_metrics(spark, monkeypatch):
    monkeypatch.setattr(metrics, "METRICS", dict(metrics.METRICS))
    metrics.register_metric("best", metrics.curve_metric(lambda: F.max("ap")))
    metrics.register_metric("quiet", metrics.hits_metric(1, True, 0.4))
    rows = predictions(spark)
    got = values(metrics.finish_metrics(metrics.metric_state(rows, ["best", "quiet"]), ["best", "quiet"]))
    long = rows.withColumn("row_id", F.monotonically_increasing_id()).transform(metrics.unpivot)
    assert got == {"best": round(metrics.average_precision(long).agg(F.max("ap")).first()[0], 9), "quiet": round(metrics.topk_accuracy(rows, 1, True, 0.4).first()[0], 9)}


def test_a_stream_is_stopped_and_started(spark, tmp_path):
    given, out, state = (f"file://{tmp_path}/{n}" for n in ("given", "out", "state"))
    rows = predictions(spark, 90)
    for i in range(3):
        rows.where(F.pmod(F.xxhash64("scores"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(given)
    start = lambda: streams.start_metric_states(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(given), out, state, availableNow=True)
    start().awaitTermination()
    more = predictions(spark, 150).where(F.pmod(F.xxhash64("scores"), F.lit(7)) == 1)
    more.coalesce(1).write.mode("append").parquet(given)
    start().awaitTermination()
    want = values(metrics.finish_metrics(metrics.metric_state(rows.unionByName(more))))
    sink = streams.states_sink(out)
    assert values(metrics.finish_metrics(sink.read(spark))) == want
    assert len(os.listdir(tmp_path / "out")) == 4
    # the last batch is run again, as after a failure before its commit
    last = max(int(n) for n in os.listdir(tmp_path / "state" / "commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(tmp_path / "state" / "commits" / name):
            os.remove(tmp_path / "state" / "commits" / name)
    start().awaitTermination()
    assert values(metrics.finish_metrics(sink.read(spark))) == want


def test_batches_are_merged(spark, tmp_path):
    sink = streams.counts_sink(f"file://{tmp_path}/counts", compact=3)
    assert sink.read(spark).count() == 0
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "pred int, true int")
    for number in range(8):
        sink.write(streams.stream_metric_counts(rows), number)
    sink.write(streams.stream_metric_counts(rows), 7)
    assert sorted(n for n in os.listdir(tmp_path / "counts") if n.startswith("upto")) == ["upto=2", "upto=5"]
    assert sorted(map(tuple, sink.read(spark).collect())) == [(1, 1, 8, 8), (1, 2, 8, 0), (2, 2, 8, 8)]
    os.remove(tmp_path / "counts" / "upto=5" / "_SUCCESS")  # a merge that ended early isn't read
    assert sorted(map(tuple, sink.read(spark).collect())) == [(1, 1, 8, 8), (1, 2, 8, 0), (2, 2, 8, 8)]
