"""Event intervals of recordings: arrays of [start, end] with a parallel array of clusters. No operator shuffles but grid_labels and merge_windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform

NOISE = -1


def _zipped(df: DataFrame) -> DataFrame:
    return df.withColumn("_e", F.zip_with("detected_events", "event_cluster", lambda e, c: F.struct(e.alias("e"), c.alias("c"))))


def _unzipped(df: DataFrame) -> DataFrame:
    return df.withColumn("detected_events", F.transform("_e", lambda x: x["e"])).withColumn("event_cluster", F.transform("_e", lambda x: x["c"])).drop("_e")


def drop_noise_events(df: DataFrame) -> DataFrame:
    """Drop events of cluster -1, but keep a recording's only event."""
    kept = F.when(F.size("_e") == 1, F.col("_e")).otherwise(F.filter("_e", lambda x: x["c"] != NOISE))
    return _unzipped(_zipped(df).withColumn("_e", kept))


def biggest_cluster(df: DataFrame) -> DataFrame:
    """Keep the events of the most frequent cluster; of equal ones the smallest id."""
    clusters = F.col("event_cluster")
    best = F.array_max(F.transform(F.array_distinct(clusters), lambda c: F.struct(F.size(F.filter(clusters, lambda x: x == c)).alias("n"), (-c).alias("neg"))))
    return _unzipped(_zipped(df).withColumn("_m", -best["neg"]).withColumn("_e", F.filter("_e", lambda x: x["c"] == F.col("_m")))).drop("_m")


def explode_events(df: DataFrame, biggest: bool = True, default: tuple[float, float] = (0.0, 5.0)) -> DataFrame:
    """One row for each event left; a recording without one gives a row with the default interval and no cluster."""
    rows = drop_noise_events(df)
    rows = biggest_cluster(rows) if biggest else rows
    rows = _zipped(rows).withColumn("_one", F.explode_outer("_e")).drop("_e")
    event = F.coalesce(F.col("_one.e"), F.array(F.lit(default[0]), F.lit(default[1])))
    cluster = F.when(F.col("_one").isNull(), F.array().cast("array<int>")).otherwise(F.array("_one.c"))
    rows = rows.withColumn("detected_events", event).withColumn("event_cluster", cluster).drop("_one")
    for name, kind in rows.dtypes:
        if kind.startswith("array") and name not in ("detected_events", "event_cluster"):
            rows = rows.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    return rows


def nocall_gaps(df: DataFrame, length: str = "length") -> DataFrame:
    """Adds `gaps`: before each event that starts after the one before it ended, and the tail."""
    ends = F.concat(F.array(F.lit(0.0)), F.transform("detected_events", lambda e: e[1]))
    starts = F.concat(F.transform("detected_events", lambda e: e[0]), F.array(F.col(length).cast("double")))
    return df.withColumn("gaps", F.filter(F.zip_with(ends, starts, lambda a, b: F.array(a, b)), lambda g: g[0] < g[1]))


def choose_interval(df: DataFrame) -> DataFrame:
    """Adds `interval`: the detected event, else start and end time, else null (the whole file)."""
    event = F.when(F.size("detected_events") == 2, F.col("detected_events"))
    own = F.when(F.col("start_time").isNotNull() & F.col("end_time").isNotNull(), F.array("start_time", "end_time"))
    return df.withColumn("interval", F.coalesce(event, own))


def shift_window(df: DataFrame, key: str, duration: str = "duration", extension: float = 8.0, extracted: float = 5.0, seed: int = 0) -> DataFrame:
    """Widen short events to `extension`, clamp them to the recording and cut `extracted` seconds at a repeatable random start."""
    s, e, d = F.col("s"), F.col("e"), F.col(duration)
    short = e - s < extension
    more = (F.lit(extension) - (e - s)) / 2
    low, high = s - more, e + more
    start = F.when(~short, s).when(low < 0, F.lit(0.0)).when(high > d, F.greatest(F.lit(0.0), d - extension)).otherwise(low)
    end = F.when(~short, e).when(low < 0, F.least(F.lit(extension), d)).when(high > d, d).otherwise(high)
    begin = start + (F.greatest(F.lit(0.0), end - extracted) - start) * uniform(seed, key)
    return df.withColumn("cut_start", begin).withColumn("cut_end", F.col("cut_start") + extracted)


def clamp_interval(df: DataFrame, min_len: float = 1.0, max_len: float = 5.0, sr: int = 32000) -> DataFrame:
    """Adds new_start, new_end and sample offsets first_sample, last_sample."""
    s, e = F.coalesce("s", F.lit(0.0)), F.col("e")
    end = F.when(e - s < min_len, s + min_len).when(e - s > max_len, s + max_len).otherwise(e)
    return df.withColumn("new_start", s).withColumn("new_end", end).withColumn("first_sample", (F.col("new_start") * sr).cast("int")).withColumn("last_sample", F.coalesce((F.col("new_end") * sr).cast("int"), F.lit(int(max_len * sr))))


def center_window(df: DataFrame, min_len: float = 5.0, max_len: float = 5.0, duration: str = "duration") -> DataFrame:
    """Extend an event equally to min_len, shift it back into the recording, cut it at max_len."""
    more = F.greatest(F.lit(0.0), F.lit(min_len) - (F.col("e") - F.col("s"))) / 2
    low, high, d = F.col("s") - more, F.col("e") + more, F.col(duration)
    start = F.when(low < 0, F.lit(0.0)).when(high > d, F.greatest(F.lit(0.0), low - (high - d))).otherwise(low)
    end = F.when(low < 0, F.least(d, high - low)).when(high > d, d).otherwise(high)
    return df.withColumn("new_start", start).withColumn("new_end", F.least(end, F.col("new_start") + max_len))


def grid_labels(annotations: DataFrame, recordings: DataFrame, step: int = 5) -> DataFrame:
    """One row for each `step` seconds of a recording with the labels heard; empty ones too.

    The interval overlap is an equi-join on (file, segment number): an event is copied to the segments that it meets.
    """
    grid = recordings.select("filepath", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0)).cast("int"))).alias("no"))
    first, last = F.floor(F.col("start_time") / step).cast("int"), (F.ceil(F.col("end_time") / step) - 1).cast("int")
    met = annotations.where("end_time > start_time").select("filepath", "label", F.explode(F.sequence(first, last)).alias("no"))
    heard = met.groupBy("filepath", "no").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    out = grid.join(heard, ["filepath", "no"], "left")
    return out.select("filepath", (F.col("no") * F.lit(float(step))).alias("start_time"), ((F.col("no") + 1) * F.lit(float(step))).alias("end_time"), F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))


def split_windows(df: DataFrame, samples: str, win: int, overlap: int) -> DataFrame:
    """Cut clips longer than win into [0, win) and [win - overlap, 2 win - overlap); others stay whole."""
    a = F.col(samples)
    parts = F.when(F.size(a) > win, F.array(F.slice(a, 1, win), F.slice(a, win - overlap + 1, win))).otherwise(F.array(a))
    return df.select("*", F.posexplode(parts).alias("window_no", "window"))


def merge_windows(df: DataFrame, key: str, logits: str | None = "logits", embedding: str | None = None) -> DataFrame:
    """Combine the windows of a key: logits by elementwise maximum, embeddings by mean."""
    name, how = (logits, F.max) if logits else (embedding, F.avg)
    flat = df.select(key, F.posexplode(name).alias("pos", "x")).groupBy(key, "pos").agg(how(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda t: t["x"]).alias(name))


