"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords (whole words and byte n-grams of 2 to 4 inside
words, hashed); a softmax layer on the mean gives the languages (Joulin et al. 2017). Embeddings and
layer are trained together by mini-batch stochastic gradient descent in numpy on a bounded sample
(of each language the `max_rows` documents of smallest id hash, so rare languages are learnt too). On a part of the sample left out of training, a
temperature is fitted to the scores and the rejection threshold is set to the score that
`reject_share` of correctly predicted rows fall under; rows below it are marked `rejected`, their
prediction stays. Scoring is one scan of all whole texts without a shuffle.

Defined results: null texts and texts without a letter are `und` with score 0; an empty training set
makes every text `und`; a repeated doc_id is predicted row by row; null languages are not learnt
from. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K

BUCKETS, DIM = 1 << 15, 16
MAX_ROWS = 500
SEED = 31
NONE = "und"


def subwords(chunk: K.Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (position, bucket): subwords starting at byte positions, in lower case for A-Z; n-grams don't cross white space."""
    low = K.LOWER[chunk.data]
    solid = ~K.SPACE[low]
    edges = chunk.byte_offsets[1:-1]
    code, inside = low.astype(np.uint32), solid.copy()
    out, key = [], code.copy()
    for n in (2, 3, 4):
        key = key[:-1] * np.uint32(0x01000193) ^ code[n - 1 :]
        inside = inside[:-1] & solid[n - 1 :]
        across = edges - (n - 1)  # an n-gram from there would run into the next document
        inside[across[(across >= 0) & (across < len(inside))]] = False
        at = np.flatnonzero(inside)
        out.append((at, ((key[at] * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(17)).astype(np.int32)))
    if len(chunk.starts):
        out.append((chunk.starts, (chunk.hashes(lower=True) >> K.U64(49)).astype(np.int32)))
    return out


def sums(chunk: K.Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every document the sum of its subwords' rows of the table, and their number."""
    total, count = np.zeros((chunk.n, table.shape[1])), np.zeros(chunk.n)
    for at, bucket in subwords(chunk):
        n = np.diff(np.searchsorted(at, chunk.byte_offsets))
        count += n
        if len(at):
            full = np.flatnonzero(n)
            total[full] += np.add.reduceat(table[bucket], (np.cumsum(n) - n)[full], axis=0)
    return total, count


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (lang, distinct buckets, their counts)."""
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        for chunk in K.chunks(batch.column("text")):
            parts = subwords(chunk)
            for i in range(chunk.n):
                lo, hi = chunk.byte_offsets[i], chunk.byte_offsets[i + 1]
                mine = np.concatenate([b[np.searchsorted(at, lo) : np.searchsorted(at, hi)] for at, b in parts] or [np.zeros(0, np.int32)])
                bucket, count = np.unique(mine, return_counts=True)
                yield pa.RecordBatch.from_pylist([{"lang": lang[chunk.first + i], "buckets": bucket, "counts": count}], schema=_GATHERED)


_GATHERED = pa.schema([("lang", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, reject_below: float):
        self.langs, self.table, self.temperature, self.reject_below = langs, table, temperature, reject_below

    def predict(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        n = len(texts)
        best, score = np.full(n, -1), np.zeros(n)
        if self.langs:
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for chunk in K.chunks(texts):
                total, count = sums(chunk, self.table)
                p = softmax(total / np.maximum(1, count)[:, None] / self.temperature)
                at = slice(chunk.first, chunk.first + chunk.n)
                best[at], score[at] = p.argmax(axis=1), p.max(axis=1)
            best[~letters], score[~letters] = -1, 0.0
        names = pa.array([*self.langs, NONE])
        return names.take(pa.array(np.where(best < 0, len(self.langs), best))), pa.array(score), pa.array(score < self.reject_below)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, batch: int = 16, reject_share: float = 0.01, seed: int = SEED) -> Model:
    """Train on rows (lang, buckets, counts); a fifth of them calibrates."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r[0]) for r in rows])
    tuned = rng.random(len(rows)) < (0.2 if len(rows) >= 50 else 0.0)
    train = np.flatnonzero(~tuned)
    share = np.bincount(y[train], minlength=len(langs)) / max(1, len(train))
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    w += rng.normal(0, 0.1, w.shape)
    weight = [r[2] / r[2].sum() for r in rows]
    for epoch in range(epochs):
        order, step = rng.permutation(train), rate * 20 * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            idx = np.concatenate([rows[i][1] for i in ids])
            part = np.concatenate([weight[i] for i in ids])
            size = np.array([len(rows[i][1]) for i in ids])
            h = np.add.reduceat(e[idx] * part[:, None], np.cumsum(size) - size, axis=0)
            g = softmax(h @ w + b)
            g[np.arange(len(ids)), y[ids]] -= 1
            g *= np.minimum(20.0, 1 / (len(langs) * share[y[ids]]))[:, None] / len(ids)  # rare languages count more
            back = g @ w.T
            w -= step * 0.1 * (h.T @ g)
            b -= step * 0.01 * g.sum(axis=0)
            np.subtract.at(e, idx, step * part[:, None] * np.repeat(back, size, axis=0))
    table = e @ w + b
    some = np.flatnonzero(tuned) if tuned.any() else np.arange(len(rows))
    z = np.stack([weight[i] @ table[rows[i][1]] for i in some])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(some)), y[some]] + 1e-12).mean()
    temperature = min((float(t) for t in np.geomspace(0.05, 5, 41)), key=loss)
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[some]]
    return Model(langs, table.astype(np.float32), temperature, float(np.quantile(right, reject_share)) if len(right) else 0.0)


def train(docs: DataFrame, max_rows: int = MAX_ROWS, seed: int = SEED) -> Model:
    """Fit on documents with a language outside the held-out third (crc32 of the id modulo 3 is 1)."""
    C.arrow_rows(docs.sparkSession)
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    known = texts.where(F.col("lang").isNotNull() & ~C.held_out("doc_id", 3, 1))
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")  # a top-k: Spark cuts each task's rows before the shuffle
    ids = known.where("text is not null").select("lang", "doc_id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_rows)
    found = known.where("text is not null").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "text")
    table = found.mapInArrow(gather, "lang string, buckets array<int>, counts array<int>").toArrow()
    return fit([(a, np.asarray(b, np.int64), np.asarray(c, float)) for a, b, c in zip(table["lang"].to_pylist(), (x.values.to_numpy() for x in table["buckets"]), (x.values.to_numpy() for x in table["counts"]), strict=True)])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for the whole text of every document."""
    C.arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, score, rejected], names=["doc_id", "lang_pred", "score", "rejected"])

    return C.rows_of(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return predicted(docs, train(docs)).select("doc_id", C.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable] = {"op4_language": op4_language}
