"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences.

Words (lower case, without marks at their ends) are hashed into TERMS buckets and weighted by inverse
document frequency, counted over all documents. A word carries no content if it's common in the documents and
in the benchmark too: a leak, however often copied, makes its words common in the documents alone. A randomised SVD
(Halko, Martinsson and Tropp 2011) of the TF-IDF rows A of all passages of the benchmark and of the corpus gives the
latent space (beyond `sample_docs` documents and `block` items, each row weighs less: the corpus as a whole weighs as
these would, however large): A'(A S) with a sparse random S is a sum over Spark's partitions in one pass over all
texts, and the singular vectors follow from it and S on the driver, whatever the input. Then one scan of all whole
texts, with no shuffle, projects every passage (WIDE words, every STEP words), finds items by cosine, and checks each
find exactly: the longest common subsequence of the content words of the item and of the text around the passage, as
far as the item is long on either side, must cover LCS_SURE of the item, or LCS_LEAST of it and all content words of
its answer (its last sentence) must stand there too.

Items of more than 2 x WIDE words are looked for by each of their passages too.

One scan of the documents looks for all items, of which a worker has KEPT blocks of about BLOCK items and passages of long
ones ready at once; a benchmark of more than SCAN_BYTES takes a scan for each of these, so what is sent to the driver and
the executors has a fixed size. Items and documents never form all pairs in a join.

Defined results: null and empty texts and items match nothing; items of fewer than 4 content words are compared
by all their words wherever one of their rarest stands, without a cosine (given as 0), and match nothing if these
are fewer than 8; rows that repeat a doc_id, and different texts of an item_id, give one row for each pair found; an empty table
on either side gives an empty result. Extra columns are ignored by leaks() and kept by without_leaks().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K
from .packed import SLICES, pack, unpacked_sum
from .toxicity import _EDGE

#: Hash buckets of terms, dimensions of the latent space, and columns of the sketch beyond these.
TERMS, RANK, SPARE = 1 << 15, 64, 16
WIDE, STEP = 32, 16
SAMPLE_DOCS, BLOCK, SEED = 1000, 2000, 5
#: Documents of a chunk up to which terms are told apart in a table, beyond by sorting.
MARKED = 512
#: Words in more than this share of the documents, and of the benchmark's different texts, carry no content.
COMMON = 0.03
#: The least weight of a term that some content word of the benchmark has, were it in all documents.
FLOOR = 0.1
#: Items compared by all words: the least share, and the fewest words that tell.
ALL_SHARE, ALL_LEAST = 0.9, 8
COSINE, LCS_SURE, LCS_LEAST = 0.35, 0.8, 0.6
#: Words before and after a found passage that are compared too, at least; as many as the item has, if more.
AROUND = 48
#: Cosines held at once.
CELLS = 1 << 23
#: Content words below which an item is compared by all its words.
CONTENT_LEAST = 4
#: Bytes of items that one scan looks for, and blocks of items that a worker keeps ready.
SCAN_BYTES, KEPT = 32 << 20, 8
FOUND = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
#: Documents that one task of the product takes, where there are more than tasks by cores would take.
TASK_DOCS = 250_000


def word_hashes(chunk: K.Chunk) -> np.ndarray:
    starts, ends = chunk.starts.copy(), chunk.ends.copy()
    for _ in range(3):
        ends -= (ends - starts > 1) & _EDGE[chunk.data[ends - 1]]
        starts += (ends - starts > 1) & _EDGE[chunk.data[starts]]
    return chunk.hashes(lower=True, starts=starts, ends=ends)


def term(word: np.ndarray) -> np.ndarray:
    return (word >> K.U64(49)).astype(np.int64)


def among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which words are in the sorted array `known`."""
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words if len(known) else np.zeros(len(words), bool)


def _counted(words: np.ndarray, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, marks, exact = np.zeros(TERMS, np.int64), 0, np.empty(MARKED * TERMS, np.int32), np.zeros(len(words), np.int64)
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                word, doc = word_hashes(chunk), chunk.doc()
                t = term(word)
                key, n = doc * TERMS + t, np.arange(len(t), dtype=np.int32)
                if chunk.n <= MARKED:  # the last word of each (document, term) counts
                    marks[key] = n
                    counts += np.bincount(t[marks[key] == n], minlength=TERMS)
                else:
                    counts += np.bincount(np.unique(key) % TERMS, minlength=TERMS)
                docs += int((chunk.counts > 0).sum())
                if len(words):
                    at = np.flatnonzero(among(word, words))
                    exact += np.bincount(np.unique(doc[at] * len(words) + np.searchsorted(words, word[at])) % len(words), minlength=len(words))
        out = np.zeros(size, np.int64)
        out[:TERMS], out[TERMS], out[TERMS + 1 : TERMS + 1 + len(words)] = counts, docs, exact
        yield from pack(out)

    return run


def document_counts(texts: DataFrame, words: np.ndarray | None = None) -> tuple[np.ndarray, int, np.ndarray]:
    """Number of documents of each term, of documents with a word, and of each of the (sorted) words; over all of them."""
    words = np.zeros(0, K.U64) if words is None else words
    size = -(-(TERMS + 1 + len(words)) // SLICES) * SLICES
    total = unpacked_sum(texts.select("text").mapInArrow(_counted(words, size), "slice int, part binary"), size, np.int64)
    return total[:TERMS], int(total[TERMS]), total[TERMS + 1 : TERMS + 1 + len(words)]


def _own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in K.chunks(batch.column("text")):
            word, doc = word_hashes(chunk), chunk.doc()
            order = np.lexsort((word, doc))
            w, d = word[order], doc[order]
            once = np.ones(len(w), bool)
            once[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            w, n = np.unique(w[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def frequent_words(items: DataFrame) -> np.ndarray:
    """The words in more than COMMON of the benchmark's different texts (at most some 30 times the words of a text)."""
    different = items.select("text").distinct()
    n = different.count()
    rows = different.mapInArrow(_own_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > max(COMMON * n, 2)).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(K.U64))


class Sketch:
    """A sparse random matrix of TERMS rows and `size` columns: each term has one column and a sign."""

    def __init__(self, size: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size, self.column, self.sign = size, rng.integers(0, size, TERMS), rng.choice(np.array([-1.0, 1.0]), TERMS)

    def dense(self) -> np.ndarray:
        out = np.zeros((TERMS, self.size))
        out[np.arange(TERMS), self.column] = self.sign
        return out


def _gram(sketch: Sketch, weight: np.ndarray, common: np.ndarray, size: int) -> Callable:
    """A partition's share of A'(A S), S the sketch, and the number of its rows; a row of A is the TF-IDF of a passage of
    WIDE words, over the root of the sum of its words' squared weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros((sketch.size, TERMS)), 0
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                word = word_hashes(chunk)
                t = term(word)
                inside = np.arange(len(t)) - np.repeat(chunk.bounds[:-1], chunk.counts)
                passage = np.cumsum(inside % WIDE == 0) - 1
                n = int(passage[-1]) + 1 if len(passage) else 0
                passages += n
                tells = ~among(word, common) & (weight[t] > 0)
                t, passage = t[tells], passage[tells]
                if not len(t):
                    continue
                w = weight[t].astype(np.float64)
                norm = np.bincount(passage, w * w, minlength=n)
                y = np.bincount(sketch.column[t] * n + passage, w * sketch.sign[t], minlength=n * sketch.size).reshape(sketch.size, n)
                y /= np.maximum(norm, 1e-30)
                for column, of_passages in zip(total, y, strict=True):  # by column, as that is numpy's fastest sum by term
                    column += np.bincount(t, of_passages[passage] * w, minlength=TERMS)
        out = np.zeros(size, np.float32)
        out[: total.size], out[total.size] = total.T.reshape(-1), passages
        yield from pack(out)

    return run


def gram(texts: DataFrame, sketch: Sketch, weight: np.ndarray, common: np.ndarray, n: int = 0) -> tuple[np.ndarray, int]:
    """A'(A S) over the passages of all texts (about n), in one pass, and their number."""
    size = TERMS * sketch.size + SLICES
    tasks = max(8, texts.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_DOCS))  # each sends an array of fixed size
    parts = texts.select("text").coalesce(tasks).mapInArrow(_gram(sketch, weight, common, size), "slice int, part binary")
    total = unpacked_sum(parts, size, np.float32, -(-tasks // 16))
    return total[: TERMS * sketch.size].reshape(TERMS, sketch.size).astype(np.float64), int(total[TERMS * sketch.size])


def latent_space(product: np.ndarray, sketch: Sketch, rank: int = RANK) -> np.ndarray:
    """The right singular vectors (TERMS, rank) of A, from A'(A S) alone: Nystrom's formula with a small shift (Tropp et al. 2017)."""
    s = sketch.dense()
    shift = 1e-6 * np.linalg.norm(product) or 1e-12
    y = product + shift * s
    inner = s.T @ y
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values = np.maximum(values, values.max() * 1e-9)
    u, _, _ = np.linalg.svd(y @ (turn / np.sqrt(values)), full_matrices=False)
    return u[:, :rank].astype(np.float32)


class Item:
    """An item, ready to be compared: its content words and, for bit-parallel LCS, the places of each."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray, common: np.ndarray):
        self.length, keep = len(words), ~among(words, common)
        self.all_words = int(keep.sum()) < CONTENT_LEAST  # too few to tell
        self.id, words = item_id, words if self.all_words else words[keep]
        answer = answer[~among(answer, common)]
        self.n, self.answer, self.places = len(words), set(answer.tolist()), {}
        for i, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def share(self, words: list[int]) -> float:
        """Length of the longest common subsequence, over the item's length."""
        v = full = (1 << self.n) - 1
        for w in words:
            if m := self.places.get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return (self.n - bin(v).count("1")) / self.n

    def leaks(self, words: list[int]) -> float:
        """The share, where it tells of a leak; else 0."""
        s = self.share(words)
        if self.all_words:
            return s if s >= ALL_SHARE and self.n >= ALL_LEAST else 0.0
        return s if s >= LCS_SURE or s >= LCS_LEAST and self.answer and self.answer <= set(words) else 0.0

    def rarest(self, seen: dict[int, int]) -> list[int]:
        """Words of which a copy has at least one: more than may be missing, the rarest first (seen: documents of the common ones)."""
        out, n = [], 0
        for w in sorted(self.places, key=lambda w: (seen.get(w, 0), w)):
            if n > self.n - int(np.ceil(ALL_SHARE * self.n)):
                break
            out.append(w)
            n += self.places[w].bit_count()
        return out


def _whole(items: list[Item], seen: dict[int, int]) -> Callable:
    """(document, item, share) of a chunk for items that are compared by all words, wherever one of their rarest words stands."""
    pairs = sorted((w, j) for j, x in enumerate(items) for w in x.rarest(seen))
    rare, of = np.array([w for w, _ in pairs], K.U64), np.array([j for _, j in pairs], np.int64)
    known = np.array(sorted({w for x in items for w in x.places}), K.U64)

    def run(chunk: K.Chunk, word: np.ndarray) -> Iterator[tuple[int, int, float]]:
        hits = np.flatnonzero(among(word, known))
        first, last = np.searchsorted(rare, word[hits], "left"), np.searchsorted(rare, word[hits], "right")
        n = last - first
        at = np.repeat(hits, n)
        j = of[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(at))]
        doc = np.searchsorted(chunk.bounds, at, "right") - 1
        for d, at, j in np.unique(np.stack([doc, at // STEP * STEP, j]), axis=1).T.tolist():
            step = max(1, items[j].n // 8)
            long = items[j].n + 3 * step  # common words stand everywhere: only a stretch as long as the item tells
            low, high = max(at - long, chunk.bounds[d]), min(at + STEP + long, chunk.bounds[d + 1])
            if items[j].leaks(word[hits[slice(*np.searchsorted(hits, [low, high]))]].tolist()):
                starts = np.arange(low, high, step)
                ends = np.searchsorted(hits, np.minimum(starts + long, high))
                s = max(items[j].leaks(word[hits[a:b]].tolist()) for a, b in zip(np.searchsorted(hits, starts), ends, strict=True))
                if s:
                    yield d, j, s

    return run


class Passages:
    """A chunk's words, those among them that some item has (hits), and its passages."""

    def __init__(self, chunk: K.Chunk, known: np.ndarray):
        self.chunk, self.word = chunk, word_hashes(chunk)
        self.hits = np.flatnonzero(among(self.word, known))
        self.inside = np.arange(len(self.word)) - np.repeat(chunk.bounds[:-1], chunk.counts)
        self.starts = np.flatnonzero(self.inside % STEP == 0)
        self.doc = np.searchsorted(chunk.bounds, self.starts, "right") - 1
        end = np.minimum(self.starts + WIDE, chunk.bounds[self.doc + 1])
        self.own, self.own_end = np.searchsorted(self.hits, self.starts), np.searchsorted(self.hits, end)


def _search(items: list[Item], vectors: np.ndarray, of: np.ndarray, projected: np.ndarray, seen: dict[int, int]) -> Callable:
    """Search for a block's items: (document of the chunk, item_id, cosine, share) of each one found.

    of: the item of each vector; projected: the latent vectors of the terms, weights included; seen: the documents of the common words.
    """
    content = np.array([not x.all_words for x in items], bool)
    short = [x for x in items if x.all_words and x.n >= ALL_LEAST]
    vectors, of = vectors[content[of]], (np.cumsum(content) - 1)[of[content[of]]]
    items = [x for x in items if not x.all_words]
    whole = _whole(short, seen)
    need = np.array([max(1, int(np.ceil(LCS_LEAST * x.n))) for x in items])
    # content words of a passage of the item, and of the item where it's shorter
    own_need = 0.4 * np.array([min(k, WIDE * x.n / x.length) for k, x in zip(need, items, strict=True)])
    around = np.array([max(AROUND, x.length) for x in items])
    apart = np.array([max(STEP, x.length // 4) for x in items])  # of the finds within so many words one is compared, with as much more text
    around += np.where(apart > STEP, apart, 0)
    least = max(float(own_need.min(initial=1 << 30)), 1)

    def run(at: Passages) -> Iterator[tuple[int, int, float, float]]:
        chunk, word, hits = at.chunk, at.word, at.hits
        best: dict[tuple[int, int], tuple[float, float]] = {}
        if len(word) and short:
            for d, j, s in whole(chunk, word):
                if s > best.get((d, len(items) + j), (0.0, 0.0))[0]:
                    best[d, len(items) + j] = s, 0.0
        mine = at.own_end - at.own
        some = np.flatnonzero(mine >= least)
        if len(some):
            total = np.zeros((len(hits) + 1, projected.shape[1]))
            np.cumsum(projected[term(word[hits])], axis=0, out=total[1:])
        rows = max(1, CELLS // max(len(vectors), 1))
        for first_row in range(0, len(some), rows):
            p = some[first_row : first_row + rows]
            passage = (total[at.own_end[p]] - total[at.own[p]]).astype(np.float32)
            norm = np.sqrt(np.einsum("ij,ij->i", passage, passage))
            norm[norm < 1e-6] = np.inf
            close = (passage @ vectors.T) / norm[:, None]
            i, v = np.nonzero(close >= COSINE)
            cosine, i, j = close[i, v], p[i], of[v]
            fit = mine[i] >= own_need[j]
            cosine, i, j = cosine[fit], i[fit], j[fit]
            doc, start = at.doc[i], at.starts[i]
            low, high = np.maximum(start - around[j], chunk.bounds[doc]), np.minimum(start + WIDE + around[j], chunk.bounds[doc + 1])
            first, last = np.searchsorted(hits, low), np.searchsorted(hits, high)
            fit = np.flatnonzero(last - first >= need[j])
            fit = fit[np.argsort(-cosine[fit], kind="stable")]
            _, once = np.unique(np.stack([doc[fit], j[fit], at.inside[start[fit]] // apart[j[fit]]]), axis=1, return_index=True)
            for k in fit[once].tolist():
                key = int(doc[k]), int(j[k])
                if (s := items[key[1]].leaks(word[hits[first[k] : last[k]]].tolist())) > best.get(key, (0.0, 0.0))[0]:
                    best[key] = s, float(cosine[k])
        for (d, j), (s, cosine) in best.items():
            yield d, (items + short)[j].id, cosine, s

    return run


def _found(blocks: list[list[tuple[int, str]]], common: np.ndarray, known: np.ndarray, projected: np.ndarray, seen: dict[int, int]) -> Callable:
    """One scan for all blocks of (item_id, text): words are hashed and looked up once for all of them.

    A worker makes a block ready when it first needs it and keeps the last KEPT ones. Only content words that some item
    has (known) are projected: others can't be part of a common subsequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = lru_cache(KEPT)(lambda k: _search(*_items(blocks[k], common, projected), projected, seen))
        order = list(range(len(blocks)))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            passages = [Passages(c, known) for c in K.chunks(batch.column("text"))]
            for k in order:
                found = [(ids[at.chunk.first + d], *x) for at in passages for d, *x in ready(k)(at)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), FOUND, strict=True)], names=["doc_id", "item_id", "cosine", "lcs"])
            order.reverse()  # begins with the blocks that are still kept

    return run


def _items(rows: list[tuple[int, str]], common: np.ndarray, projected: np.ndarray) -> tuple[list[Item], np.ndarray, np.ndarray]:
    """The block's items, and latent unit vectors: of each, and of the passages of long ones; with the item of each vector."""
    items, vectors, of = [], [], []
    for item_id, text in rows:
        (chunk,) = K.chunks(pa.array([text]))
        words = word_hashes(chunk)
        ends = [e for e, last in zip(chunk.ends, chunk.data[chunk.ends - 1], strict=True) if last in b".!?"]
        after = ends[-2] if len(ends) > 1 else 0
        if len(words):
            items.append(Item(item_id, words, words[chunk.starts >= after], common))
            for part in [words, *([words[i : i + WIDE] for i in range(0, len(words), WIDE)] if len(words) > 2 * WIDE else [])]:
                v = projected[term(part[~among(part, common)])].sum(axis=0)
                vectors.append(v / (np.linalg.norm(v) or np.inf))
                of.append(len(items) - 1)
    return items, np.array(vectors, np.float32).reshape(len(vectors), projected.shape[1]), np.array(of, np.int64)


def _known(rows: list[tuple[int, str]], common: np.ndarray) -> np.ndarray:
    """The content words, sorted, of the items that have enough of them to be compared by these."""
    out = [np.zeros(0, K.U64)]
    for chunk in K.chunks(pa.array([text for _, text in rows], pa.string())):
        word, doc = word_hashes(chunk), chunk.doc()
        keep = ~among(word, common)
        out.append(np.unique(word[keep & (np.bincount(doc[keep], minlength=chunk.n) >= CONTENT_LEAST)[doc]]))
    return np.unique(np.concatenate(out))


def _blocks(rows: list[tuple[int, str]], block: int) -> list[list[tuple[int, str]]]:
    """Runs of rows of about `block` vectors each."""
    out, room = [], 0
    for item_id, text in rows:
        words = len(text.split())
        if room <= 0:
            out.append([])
            room = block
        out[-1].append((item_id, text))
        room -= 1 + (words // WIDE if words > 2 * WIDE else 0)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, sample_docs: int = SAMPLE_DOCS, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): the benchmark items found in documents."""
    spark = docs.sparkSession
    C.arrow_rows(spark)
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"}).where("text is not null")
    items = C.rows_of(benchmark, {"item_id": "long", "text": "string"}).where("text is not null")
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()
    frequent = frequent_words(items)
    counts, n, exact = document_counts(texts, frequent)
    everywhere = exact > max(COMMON * n, 2)
    common, seen = frequent[everywhere], dict(zip(frequent[everywhere].tolist(), exact[everywhere].tolist(), strict=True))
    weight = np.maximum(np.log((n + 1) / (counts + 1)), FLOOR).astype(np.float32)
    weight[(counts > max(COMMON * n, 2)) & (document_counts(items)[0] == 0)] = 0
    sketch = Sketch(RANK + SPARE)
    whole, fitted = 0.09 * min(1.0, sample_docs / max(n, 1)), min(1.0, block / max(n_items, 1))  # how much a passage of either counts
    product = whole * gram(texts, sketch, weight, common, n)[0] + fitted * gram(items, sketch, weight, common, n_items)[0]
    projected = latent_space(product, sketch) * weight[:, None]
    out = None
    scans = max(1, -(-n_bytes // scan_bytes))
    for k in range(scans):
        mine = items.distinct().where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == k)
        rows = [(r["item_id"], r["text"]) for r in mine.collect()]  # about scan_bytes
        found = texts.mapInArrow(_found(_blocks(rows, block), common, _known(rows, common), projected, seen), "doc_id long, item_id long, cosine double, lcs double")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found."""
    gone = C.staged(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return C.join_sized(docs, gone, "doc_id", "left_anti", F.lit(16))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable] = {"op7_decontamination": op7_decontamination}
