"""Quality classifier: Naive Bayes support vectors.

N-gram indicators of a document are scaled by the log-count ratios of the two classes; a linear
hinge-loss model is then fitted on the scaled indicators by dual coordinate descent (Wang and
Manning 2012; Hsieh et al. 2008). The n-grams are those of words and of word shapes (case, last
character, length class, whether a word repeats the one before), hashed into buckets, so that junk
made of words never seen before is still recognised.

Fitting uses a bounded sample of labelled rows (`max_rows` of each class, those of smallest id
hash); scoring is one scan of all whole texts without a shuffle.

Defined results: null and empty texts have no indicator and get the bias' score; a repeated doc_id is
scored row by row; labels that are null are not learnt from, an id labelled both ways counts as 1;
with no label of one class all scores are next to the share of class 1 (within 0.01; 0.5 without labels). Extra columns
of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import tokens as K

BUCKETS = 1 << 18
MAX_ROWS = 3000
THRESHOLD = 0.3
SEED = 11


def indicators(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct n-gram of the chunk's documents."""
    doc, n = chunk.doc(), len(chunk.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = chunk.hashes(lower=True)
    same_doc = np.concatenate([[False], doc[1:] == doc[:-1]])
    repeat = same_doc & np.concatenate([[False], word[1:] == word[:-1]])
    kind = np.full(256, 7, np.uint8)
    kind[128:] = 0
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[ord(".")], kind[ord(",")], kind[[ord(x) for x in "!?"]], kind[[ord(x) for x in "|*#%$&"]] = 3, 4, 5, 6
    first, last = kind[chunk.data[chunk.starts]], kind[chunk.data[chunk.ends - 1]]
    upper = np.concatenate([[0], np.cumsum(kind[chunk.data] == 1)])
    shape = first.astype(np.int64) * 8 + last
    shape = shape * 2 + (upper[chunk.ends] - upper[chunk.starts] > 1)
    shape = shape * 8 + np.minimum(7, np.log2(chunk.ends - chunk.starts + 1).astype(np.int64))
    shape = (shape * 2 + repeat).astype(K.U64)
    salt = lambda x, k: K.mix(x + K.U64(k))
    pair = lambda x: salt(x[:-1] * K.U64(0x9E3779B97F4A7C15) + x[1:], 77)
    grams = [(doc, salt(word, 1)), (doc, salt(shape, 2)), (doc[1:][same_doc[1:]], pair(word)[same_doc[1:]]), (doc[1:][same_doc[1:]], pair(shape)[same_doc[1:]])]
    d = np.concatenate([g[0] for g in grams])
    b = (np.concatenate([g[1] for g in grams]) % K.U64(BUCKETS)).astype(np.int64)
    keep = K.first_of_each(d, b, BUCKETS)
    return d[keep], b[keep]


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) to rows (y, buckets)."""
    for batch in batches:
        y = np.asarray(batch.column("y").to_pylist(), np.int32)
        for chunk in K.chunks(batch.column("text")):
            d, b = indicators(chunk)
            b = b[np.argsort(d, kind="stable")]
            at = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=chunk.n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y[chunk.first : chunk.first + chunk.n]), pa.ListArray.from_arrays(pa.array(at), pa.array(b.astype(np.int32)))], names=["y", "buckets"])


def fit(y: np.ndarray, at: np.ndarray, idx: np.ndarray, passes: int = 12, c: float = 1.0, seed: int = SEED) -> tuple[np.ndarray, float, float, float]:
    """Weights by bucket and bias of the margin, then slope and offset of its logistic calibration.

    y: 0 or 1 for each row; row i has the buckets idx[at[i]:at[i+1]].
    """
    n = len(y)
    share = float(y.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), 0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))
    row = np.repeat(np.arange(n), np.diff(at))
    seen = np.bincount(idx, minlength=BUCKETS)
    p = 1.0 + np.bincount(idx[y[row] == 1], minlength=BUCKETS)
    q = 1.0 + np.bincount(idx[y[row] == 0], minlength=BUCKETS)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[seen < 3] = 0.0  # an n-gram of one or two rows says nothing of others
    size = np.sqrt(np.maximum(1.0, np.diff(at)))
    x = ratio[idx] / size[row]
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.where(y == 1, c * 0.5 / share, c * 0.5 / (1 - share))
    norm = np.add.reduceat(np.append(x * x, 0.0), np.minimum(at[:-1], len(x))) * (np.diff(at) > 0) + 1.0
    w, bias, alpha, rng = np.zeros(BUCKETS), 0.0, np.zeros(n), np.random.default_rng(seed)
    margin_at = np.zeros(n)
    for _ in range(passes):
        for i in rng.permutation(n):
            lo, hi = at[i], at[i + 1]
            g = sign[i] * (x[lo:hi] @ w[idx[lo:hi]] + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[idx[lo:hi]] += step * x[lo:hi]
                bias += step
                alpha[i] = new
    out = (w * ratio).astype(np.float32)
    margin_at = K.group_sums(out[idx].astype(np.float64), np.diff(at)) / size + bias
    slope, offset = calibrated(margin_at, y)
    return out, bias, slope, offset


def calibrated(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's logistic fit of labels on margins, by Newton steps, with his smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(a), 0.0), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(y, text) of at most max_rows labelled documents of each class outside the held-out fold."""
    known = C.rows_of(labels, {"doc_id": "long", label: "int"}).where(F.col(label).isin(0, 1) & ~C.held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = [C.sample_by_hash(known.where(F.col("y") == k), "doc_id", max_rows, seed) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most 2 * max_rows ids
    return C.rows_of(docs, {"doc_id": "long", "text": "string"}).join(F.broadcast(picked), "doc_id").select("y", "text")


class Model:
    """A fitted classifier; score() is the only thing that tasks run."""

    def __init__(self, parts: tuple[np.ndarray, float, float, float]):
        self.weights, self.bias, self.slope, self.offset = parts

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for chunk in K.chunks(texts):
            d, b = indicators(chunk)
            n = np.bincount(d, minlength=chunk.n)
            m = np.bincount(d, weights=self.weights[b], minlength=chunk.n) / np.sqrt(np.maximum(1.0, n)) + self.bias
            out[chunk.first : chunk.first + chunk.n] = 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, seed: int = SEED) -> Model:
    spark = docs.sparkSession
    C.arrow_rows(spark)
    table = training_rows(docs, labels, label, max_rows, seed).mapInArrow(gather, "y int, buckets array<int>").toArrow().combine_chunks()
    y, lists = table["y"].to_numpy().astype(np.int64), table["buckets"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(y):
        return Model(fit(y, np.zeros(1, np.int64), np.zeros(0, np.int64)))
    at, idx = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)
    return Model(fit(y, at - at[0], idx[at[0] : at[-1]]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each document's columns as one struct, so that no name clashes, and the score of its whole text."""
    C.arrow_rows(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    kind = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(batch.column("text")))], names=["row", "score"])

    return packed.mapInArrow(run, kind)


def digest(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    out = scored(C.rows_of(docs, {"doc_id": "long", "text": "string"}), model).select("row.doc_id", "score")
    return out.select("doc_id", C.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns unchanged."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= threshold).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return digest(docs, train(docs, labels), THRESHOLD)


QUERIES: dict[str, Callable] = {"op1_quality": op1_quality}
