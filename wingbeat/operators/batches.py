"""User functions: over batches of rows, over single rows, and as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 300
#: Clips whose spectrograms are given back at once, and frames of a clip transformed at once.
CLIPS, FRAMES = 16, 256


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, drop: list[str] | None = None, size: int = BATCH) -> DataFrame:
    """A function from a dict of column lists to another, which may change the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                yield pd.DataFrame(function({c: pdf[c].iloc[at : at + size].tolist() for c in pdf.columns}))

    return df.drop(*(drop or [])).mapInPandas(run, schema)


def map_rows(df: DataFrame, name: str, expression: Column) -> DataFrame:
    return df.withColumn(name, expression)


#: The body of the table function, from its arguments alone.
_KEPT = "if(size(events) = 1, {z}, filter({z}, x -> x.cluster <> -1))".format(z="zip_with(events, clusters, (e, c) -> named_struct('event', e, 'cluster', c))")
_COUNTED = f"transform(array_distinct(transform({_KEPT}, x -> x.cluster)), k -> named_struct('n', size(filter({_KEPT}, x -> x.cluster = k)), 'first', -k))"
_CHOSEN = f"if(biggest, filter({_KEPT}, x -> x.cluster = -array_max({_COUNTED}).first), {_KEPT})"


def register_event_rows(spark: SparkSession, name: str = "event_rows") -> None:
    """A table function for SQL, of a recording's events and clusters: FROM recordings r, LATERAL event_rows(r.detected_events, r.event_cluster, true).

    One row for each event left after noise and, if `biggest`, minor clusters are dropped; one with the interval from 0 to
    5 and no cluster where none is left. Its body is SQL, so the optimizer turns a call into a generator within the
    scan's stage: no shuffle, no Python.
    """
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(events ARRAY<ARRAY<DOUBLE>>, clusters ARRAY<INT>, biggest BOOLEAN)"
        " RETURNS TABLE (detected_events ARRAY<DOUBLE>, event_cluster ARRAY<INT>)"
        " RETURN SELECT coalesce(x.event, array(0D, 5D)), if(x IS NULL, CAST(array() AS ARRAY<INT>), array(x.cluster))"
        f" FROM (SELECT explode_outer({_CHOSEN}) AS x)"
    )


def event_rows(df: DataFrame, biggest: bool = True) -> DataFrame:
    """Recordings to event rows by the table function; the other columns are copied."""
    register_event_rows(df.sparkSession)
    others = ", ".join(f"r.`{c}`" for c in df.columns if c not in ("detected_events", "event_cluster"))
    return df.sparkSession.sql(f"SELECT {others}{', ' if others else ''}e.* FROM {{recordings}} r, LATERAL event_rows(r.detected_events, r.event_cluster, {str(biggest).lower()}) e", recordings=df)


def mel_bands(sr: int, n_fft: int, n_mels: int) -> list[tuple[int, np.ndarray]]:
    """For each band the first bin and the weights of its triangle; triangles are evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(sr / 2), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, sr / 2, n_fft // 2 + 1)
    out = []
    for low, centre, high in zip(edges[:-2], edges[1:-1], edges[2:], strict=True):
        first, stop = np.searchsorted(f, low, "right"), np.searchsorted(f, high, "left")
        some = f[first:stop]
        out.append((int(first), np.minimum((some - low) / (centre - low), (high - some) / (high - centre))))
    return out


def _mel(a: np.ndarray, window: np.ndarray, hop: int, bands: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """(bands, frames) of one clip; FRAMES frames are held at once."""
    n_fft = len(window)
    x = np.pad(a.astype(float), n_fft // 2, mode="reflect" if len(a) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    out = np.empty((len(bands), len(frames)), np.float32)
    for at in range(0, len(frames), FRAMES):
        power = np.abs(np.fft.rfft(frames[at : at + FRAMES] * window, axis=1)) ** 2
        for m, (first, weights) in enumerate(bands):
            out[m, at : at + FRAMES] = power[:, first : first + len(weights)] @ weights
    return out


def mel_features(df: DataFrame, key: str = "row_id", samples: str = "samples", sr: int = 32000, n_fft: int = 1024, hop: int = 320, n_mels: int = 128) -> DataFrame:
    """(key, mel array<array<float>>): power spectrogram on the mel scale, centred frames, Hann window.

    A task gets batches of bounded bytes and gives one of at most CLIPS clips back at a time; a null or empty clip has a
    null result.
    """
    window, bands = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft), mel_bands(sr, n_fft, n_mels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CLIPS):
                part = batch.slice(at, CLIPS)
                clips = [clip.values.to_numpy(zero_copy_only=False) if clip.is_valid else () for clip in part.column(1)]
                mels = [_mel(a, window, hop, bands) if len(a) else None for a in clips]
                frames = np.array([0 if m is None else m.shape[1] for m in mels])
                flat = np.concatenate([m.ravel() for m in mels if m is not None]) if frames.any() else np.zeros(0, np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(frames, np.where(frames > 0, n_mels, 0)))]).astype(np.int32)), pa.array(flat))
                bounds = np.concatenate([[0], np.cumsum(np.where(frames > 0, n_mels, 0))])
                ends = pa.array([None if m is None else int(b) for m, b in zip(mels, bounds, strict=False)] + [int(bounds[-1])], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, rows)], names=[key, "mel"])

    values = F.col(samples).cast("array<float>") if dict(df.dtypes)[samples] != "array<double>" else F.col(samples)
    return df.select(F.col(key).cast("long").alias(key), values.alias(samples)).mapInArrow(run, f"{key} long, mel array<array<float>>")
