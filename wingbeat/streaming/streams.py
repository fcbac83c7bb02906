"""Operators on unbounded input. State is bounded: none for events, one row for each (pred, true) pair for counts, one for
each distinct score of a class for metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics
from ..operators.events import explode_events

#: After so many batches their sums are merged into one folder.
COMPACT = 32


def stream_explode_events(recordings: DataFrame, biggest: bool = True) -> DataFrame:
    """The batch operator: stateless, so it runs in append mode."""
    return explode_events(recordings, biggest)


def stream_metric_counts(predictions: DataFrame) -> DataFrame:
    """Confusion counts and hits of a batch; running ones of a stream (complete mode)."""
    return predictions.groupBy("pred", "true").agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("pred") == F.col("true")).cast("long")).alias("correct"))


class SumsSink:
    """Sums by key over a stream, as a folder that is restartable and idempotent.

    Each micro-batch is summed by itself and overwrites the folder of its own number, so that a batch that is run
    again after a failure, or after a restart from the same checkpoint, counts once. Every `compact` batches the sums
    so far are merged into a folder upto=N; it is read only if it was written to its end, and the newest one counts
    with the batches after it.
    """

    def __init__(self, folder: str, schema: str, keys: list[str], sums: list[str], compact: int = COMPACT):
        self.folder, self.schema, self.keys, self.sums, self.compact = folder, schema, keys, sums, compact

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """The numbers of folders that were written to their end: one a batch since the last merge, or one a merge."""
        jvm = spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}=*/_SUCCESS")
        found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
        return sorted(int(re.search(rf"{kind}=(\d+)", f.getPath().toString())[1]) for f in found)

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if number and number % self.compact == 0:
            self.read(spark, before=number).write.mode("overwrite").parquet(f"{self.folder}/upto={number - 1}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The sums of all batches (with a number less than `before`)."""
        some = lambda kind: [n for n in self._numbers(spark, kind) if before is None or n < before]
        merged = some("upto")[-1:]
        batches = [n for n in some("batch") if not merged or n > merged[0]]
        paths = [f"{self.folder}/upto={n}" for n in merged] + [f"{self.folder}/batch={n}" for n in batches]
        rows = spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])


def counts_sink(folder: str, compact: int = COMPACT) -> SumsSink:
    return SumsSink(folder, "pred int, true int, total long, correct long", ["pred", "true"], ["total", "correct"], compact)


def states_sink(folder: str, compact: int = COMPACT) -> SumsSink:
    return SumsSink(folder, metrics.STATE, ["kind", "class", "score"], ["p", "n"], compact)


def start_metric_counts(predictions: DataFrame, folder: str, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Sums of stream_metric_counts() in a folder, read by counts_sink(folder).read()."""
    sink = counts_sink(folder)
    return predictions.writeStream.foreachBatch(lambda batch, no: sink.write(stream_metric_counts(batch), no)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_metric_states(wide: DataFrame, folder: str, checkpoint: str, names: list[str] | None = None, **trigger: bool | str) -> StreamingQuery:
    """States of named metrics, curves and top-k hits among them, in a folder: metrics.finish_metrics(states_sink(folder).read())."""
    sink = states_sink(folder)
    return wide.writeStream.foreachBatch(lambda batch, no: sink.write(metrics.metric_state(batch, names), no)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
