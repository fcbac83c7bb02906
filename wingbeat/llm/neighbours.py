"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected onto DIMS random orthogonal directions, shifted and cut into a grid, and put in
order along a Hilbert curve (Skilling 2004), once for each of CURVES projections. On a bounded sample the
share of a curve that a window must cover is fitted so that the sample's own neighbours are found (`recall`);
the same sample's key quantiles cut every curve into ranges of that size. Spark partitions all vectors by
(curve, range); a query goes to its own range and both neighbours, is compared there with every vector by
exact distance, and its windows' best are merged and ranked again on the original vectors.

The window is a share of the curve and not a number of rows: for vectors without structure (independent
directions, as in the tests' table) any key window of fixed size loses its neighbours as the table grows; clustered
vectors fit a narrow window. Ranges with more than GROUP_ROWS rows, as equal vectors make, are dealt to
several groups by a hash of the id; queries are copied to all of them, so no group grows without bound and no
row is dropped.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or
candidates; neither do vectors of another length than most (ties: the longer); rows that repeat a vec_id
count as one (the first in array order); fewer than k candidates give all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

DIMS, BITS, CURVES = 8, 4, 32
SAMPLE, SAMPLE_QUERIES, RECALL, SEED = 6000, 200, 0.94, 3
GROUP_ROWS = 4000
K_BEST = 10


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of grid cells (n, dims), as unsigned numbers of dims * bits <= 64 bits."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work: exchange or invert the lower bits
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | ((x[i] >> bit) & 1).astype(np.uint64)
    return key


class Index:
    """The projections and, for each curve, the keys that cut it into ranges."""

    def __init__(self, sample: np.ndarray, seed: int = SEED, k: int = K_BEST):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        self.turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : min(dim, DIMS)] for _ in range(CURVES)]
        self.shifts = rng.random((CURVES, min(dim, DIMS)))
        spread = [((sample - self.centre) @ t).std(axis=0) * 3 if len(sample) else np.ones(t.shape[1]) for t in self.turns]
        self.spread = [np.where(s > 0, s, 1.0) for s in spread]
        keys = [self.key(sample, c) for c in range(CURVES)]
        share = self._window(sample, keys, k, rng) if len(sample) > 200 else 1.0
        ranges = max(1, int(1 / share))
        self.cuts = [np.unique(np.sort(x)[(np.arange(1, ranges) * len(x)) // ranges]) if len(x) else x for x in keys]

    def key(self, v: np.ndarray, curve: int) -> np.ndarray:
        place = (v - self.centre) @ self.turns[curve] / self.spread[curve] / 2 + 0.5
        place = place / 2 + self.shifts[curve] / 2  # shifted by up to half of the grid
        return hilbert((np.clip(place, 0, 0.9999) * (1 << BITS)).astype(np.int64), BITS)

    def ranges(self, v: np.ndarray) -> np.ndarray:
        """(n, CURVES): each vector's range on every curve."""
        return np.stack([np.searchsorted(self.cuts[c], self.key(v, c), "right") for c in range(CURVES)], axis=1)

    def _window(self, sample: np.ndarray, keys: list[np.ndarray], k: int, rng: np.random.Generator) -> float:
        """The least share of a curve on either side with which RECALL of the sample's true neighbours are met on some curve."""
        queries = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
        d = (sample[queries] ** 2).sum(1)[:, None] + (sample**2).sum(1) - 2 * sample[queries] @ sample.T
        d[np.arange(len(queries)), queries] = np.inf
        true = np.argpartition(d, k, axis=1)[:, :k]
        apart = np.full(true.shape, len(sample))
        for x in keys:
            rank = np.empty(len(x), np.int64)
            rank[np.argsort(x, kind="stable")] = np.arange(len(x))
            apart = np.minimum(apart, np.abs(rank[true] - rank[queries][:, None]))
        return float(np.clip((np.quantile(apart, RECALL) + 1) / len(sample), 1e-4, 1.0))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): the rows that take part."""
    rows = C.rows_of(table, {"vec_id": "long", "embedding": "array<double>"}).where("vec_id is not null and embedding is not null")
    # |x| < inf is false for NaN and infinities, null for null
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(good)
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("embedding") == (dim["dim"] if dim else 0)).groupBy("vec_id").agg(F.min("embedding").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _placed(index: Index, every: int) -> Callable:
    """Each vector once for each curve; queries also for the neighbouring ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            if not len(ids):
                continue
            place, raw = index.ranges(v), pa.array([x.tobytes() for x in v], pa.binary())
            for c in range(CURVES):
                yield _out(ids, c, place[:, c], np.zeros(len(ids), bool), raw)
                asked = np.flatnonzero(ids % every == 0)
                for step in (-1, 0, 1):
                    yield _out(ids[asked], c, place[asked, c] + step, np.ones(len(asked), bool), raw.take(pa.array(asked)))

    def _out(ids: np.ndarray, curve: int, place: np.ndarray, query: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), curve, np.int32)), pa.array(place.astype(np.int32)), pa.array(query), raw], names=["vec_id", "curve", "place", "query", "v"])

    return run


def _ranked(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy()
        ids = table["vec_id"].to_numpy()
        v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float64).reshape(len(ids), -1)
        q_ids, q, c_ids, c = ids[query], v[query], ids[~query], v[~query]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = (c * c).sum(axis=1)
        for at in range(0, len(q_ids) if len(c_ids) else 0, 256):
            near = size[None, :] - 2 * q[at : at + 256] @ c.T
            for i, row in enumerate(near):
                # a few more than k by the quick formula; then exactly, ties to smaller ids
                row[c_ids == q_ids[at + i]] = np.inf
                some = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-9 * (1 + size.max()))
                some = some[c_ids[some] != q_ids[at + i]]
                d = np.sqrt(((c[some] - q[at + i]) ** 2).sum(axis=1))
                best = np.lexsort((c_ids[some], d))[:k]
                out.append((np.full(len(best), q_ids[at + i]), c_ids[some][best], d[best]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})

    return run


def nearest(table: DataFrame, every: int, k: int = K_BEST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id is divisible by `every`."""
    C.arrow_rows(table.sparkSession)
    rows = C.staged(vectors(table), "vectors")
    sample = C.sample_by_hash(rows, "vec_id", SAMPLE, SEED).select("v").toArrow()
    flat = sample["v"].combine_chunks()
    index = Index(_matrix(flat if isinstance(flat, pa.Array) else flat.chunk(0)) if len(sample) else np.zeros((0, 1)), k=k)
    placed = C.staged(rows.mapInArrow(_placed(index, every), "vec_id long, curve int, place int, query boolean, v binary"), "placed")
    groups = placed.where("not query").groupBy("curve", "place").count().select("curve", "place", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(groups), ["curve", "place"])  # CURVES times the number of ranges, whatever the rows
    own = dealt.where("not query").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = dealt.where("query").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = own.unionByName(asked).groupBy("curve", "place", "part").applyInArrow(_ranked(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)


QUERIES: dict[str, Callable] = {"op2_neighbours": op2_neighbours}
