"""Toxicity: non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are learnt from (Kiryo et al. 2017): with class
prior p, the risk is p R+(positive) + max(0, R-(unlabelled) - p R-(positive)), and where the second
part turns negative the step is taken against it. A few linear classifiers on indicators of words and word beginnings,
started from different seeds and trained on different halves of the unlabelled rows, are averaged.

Fitting uses bounded samples (`max_positive` toxic rows, `max_unlabelled` rows of any kind, of
smallest id hash); the prior is the share of toxic rows among all labelled rows that may be learnt
from. Scoring is one scan of all whole texts without a shuffle.

Defined results: null and empty texts have no indicator and get the score of the bias; a repeated
doc_id is scored row by row; an id labelled both ways counts as toxic; null labels are not learnt
from; without a toxic example every score is next to 0 (under 1e-6). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import quality as Q
from . import tokens as K

BUCKETS = 1 << 20
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
THRESHOLD = 0.5
#: Bytes of the word beginnings that are indicators too: inflected words share them.
PREFIXES = (4, 5, 6)
#: Standard errors between its shares that an indicator needs to be learnt from.
Z_LEAST = 8.0
SEED = 23
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_buckets(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct word, in lower case and without marks at its ends, and of its first 4, 5 and 6 bytes."""
    starts, ends = chunk.starts.copy(), chunk.ends.copy()
    for _ in range(3):
        ends -= (ends - starts > 1) & _EDGE[chunk.data[ends - 1]]
        starts += (ends - starts > 1) & _EDGE[chunk.data[starts]]
    doc = chunk.doc()
    word = chunk.hashes(lower=True, starts=starts, ends=ends)
    keep = K.first_of_each(doc, (word % K.U64(1 << 40)).astype(np.int64), 1 << 40) if chunk.n < 1 << 22 else np.ones(len(doc), bool)
    doc, starts, ends = doc[keep], starts[keep], ends[keep]
    d, b = [doc], [word[keep]]
    for n in PREFIXES:
        longer = ends - starts > n
        d.append(doc[longer])
        b.append(K.mix(chunk.hashes(lower=True, starts=starts[longer], ends=starts[longer] + n) + K.U64(n)))
    d, b = np.concatenate(d), (np.concatenate(b) % K.U64(BUCKETS)).astype(np.int64)
    keep = K.first_of_each(d, b, BUCKETS)
    return d[keep], b[keep]


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) to rows (y, distinct buckets)."""
    for batch in batches:
        y = np.asarray(batch.column("y").to_pylist(), np.int32)
        for chunk in K.chunks(batch.column("text")):
            d, b = word_buckets(chunk)
            b = b[np.argsort(d, kind="stable")]
            at = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=chunk.n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y[chunk.first : chunk.first + chunk.n]), pa.ListArray.from_arrays(pa.array(at), pa.array(b.astype(np.int32)))], names=["y", "buckets"])


def fit_one(pos: tuple[np.ndarray, np.ndarray], unl: tuple[np.ndarray, np.ndarray], rows: tuple[int, int], size: int, prior: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with logistic loss; pos, unl: (row of each feature, feature), rows numbered from 0."""
    w, bias = np.zeros(size), -1.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    n_p, n_u = rows
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp = np.bincount(pos[0], weights=w[pos[1]], minlength=n_p) + bias
        su = np.bincount(unl[0], weights=w[unl[1]], minlength=n_u) + bias
        positive = -prior * sigmoid(-sp) / n_p  # slope of p R+(positive)
        negative_p, negative_u = -prior * sigmoid(sp) / n_p, sigmoid(su) / n_u  # of R-(unlabelled) - p R-(positive)
        rest = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        gp, gu = (positive + negative_p, negative_u) if rest >= 0 else (-negative_p, -negative_u)
        g = np.append(np.bincount(pos[1], weights=gp[pos[0]], minlength=size) + np.bincount(unl[1], weights=gu[unl[0]], minlength=size) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def fit(y: np.ndarray, at: np.ndarray, idx: np.ndarray, prior: float, models: int = 3, steps: int = 150, seed: int = SEED) -> tuple[np.ndarray, float, bool]:
    """Mean weights by bucket and mean bias of the classifiers; whether there was anything to learn from."""
    out = np.zeros(BUCKETS, np.float32)
    n_p = int((y == 1).sum())
    if n_p == 0 or n_p == len(y):
        return out, -30.0 if n_p == 0 else 30.0, False
    row = np.repeat(np.arange(len(y)), np.diff(at))
    # only what is surely more common among the positives than elsewhere tells of other documents
    of_p, of_u = (np.bincount(idx[y[row] == k], minlength=BUCKETS) for k in (1, 0))
    p, u, both = of_p / n_p, of_u / (len(y) - n_p), (of_p + of_u) / len(y)
    z = (p - u) / np.sqrt(np.maximum(both * (1 - both) * (1 / n_p + 1 / (len(y) - n_p)), 1e-12))
    seen = np.flatnonzero((z > Z_LEAST) & (of_p >= 5))
    new = np.full(BUCKETS, -1, np.int64)
    new[seen] = np.arange(len(seen))
    keep = new[idx] >= 0
    row, idx = row[keep], new[idx[keep]]
    rng, total, bias = np.random.default_rng(seed), np.zeros(len(seen)), 0.0
    for k in range(models):
        number = np.full(len(y), -1, np.int64)
        number[y == 1] = np.arange(n_p)
        half = (y == 0) & ((rng.random(len(y)) < 0.5) if models > 1 else True)
        half = half if half.any() else y == 0
        of_half = np.full(len(y), -1, np.int64)
        of_half[half] = np.arange(half.sum())
        p, u = number[row] >= 0, of_half[row] >= 0
        w, b = fit_one((number[row[p]], idx[p]), (of_half[row[u]], idx[u]), (n_p, int(half.sum())), len(seen), prior, steps, 0.1, 1e-4)
        total, bias = total + w / models, bias + b / models
    out[seen] = total
    return out, float(bias), True


class Model:
    def __init__(self, parts: tuple[np.ndarray, float, bool]):
        self.weights, self.bias, _ = parts

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for chunk in K.chunks(texts):
            d, b = word_buckets(chunk)
            m = np.bincount(d, weights=self.weights[b], minlength=chunk.n) + self.bias
            out[chunk.first : chunk.first + chunk.n] = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, seed: int = SEED) -> Model:
    """Fit on confirmed positives and unlabelled rows; only labels outside the held-out fold are read."""
    C.arrow_rows(docs.sparkSession)
    known = C.rows_of(labels, {"doc_id": "long", label: "int"}).where(F.col(label).isin(0, 1) & ~C.held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    prior = known.agg(F.avg("y")).first()[0]
    if not prior:
        return Model((np.zeros(BUCKETS, np.float32), -1e9, False))
    positive = C.sample_by_hash(known.where("y = 1").select("doc_id"), "doc_id", max_positive, seed).withColumn("y", F.lit(1))
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"})
    others = C.sample_by_hash(texts.select("doc_id"), "doc_id", max_unlabelled, seed + 1).distinct().withColumn("u", F.lit(1))
    picked = positive.join(others, "doc_id", "full").select("doc_id", F.when(F.col("y") == 1, 1).otherwise(0).alias("y"))
    table = texts.join(F.broadcast(picked), "doc_id").select("y", "text").mapInArrow(gather, "y int, buckets array<int>").toArrow()
    y, lists = table["y"].to_numpy().astype(np.int64), table["buckets"].combine_chunks()
    at, idx = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)
    return Model(fit(y, at - at[0], idx[at[0] : at[-1]], float(np.clip(prior, 0.01, 0.9))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Q.digest(docs, train(docs, labels), THRESHOLD)


QUERIES: dict[str, Callable] = {"op3_toxicity": op3_toxicity}
