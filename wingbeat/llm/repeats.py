"""Substring dedup by recompression: words that a run of `window` words repeats from an earlier document go.

Texts are words; words are named by hash. In each of ROUNDS rounds every maximal run of one symbol and
then every pair (left, right) of symbols gets a new name, where a hash bit of the symbol says on which
side of a pair it may stand (Jez 2016). Names depend on the named symbols alone, so all tasks name alike
without talking to each other, and equal substrings get equal symbols inside: along with each symbol
goes its context, the stretch of words that decides that the symbol stands there. If a window covers
the context, every equal window of any document has the same symbol at the same place.

1. One scan parses all documents. The root name of the whole sequence finds equal documents; all but
   the first are gone as a whole. Every window is represented by its highest-level symbol, the one that stands for
   most words of those whose context it covers (ties: the least name); a window without one by the least name of its
   words. Neighbouring windows with one symbol are a run, which is one row with a 128-bit hash of all its words.
   Equal windows have equal symbols, so they stand in runs of the same symbol.
2. Runs meet by symbol. Where all words of a run stand in an earlier document, all its windows are repeated. That leaves
   the first document of each different run, and of these only symbols that more than one different run has: passages
   that begin or end within a run. Their windows alone are hashed one by one, and meet by a 128-bit hash of all words.
   Texts aren't shuffled for it: these runs are marked in two sieves, tables of bits of bounded size that every task gets,
   by symbol and by run and document. A false hit is only one more run whose windows are compared.
3. The covered words are cut out. What goes to the texts is where runs of repeated windows begin and end.

Runs and compared windows are shuffled once each, at all sizes of the input. A run that an earlier document of the same chunk
of texts holds as well is known to be repeated there and isn't shuffled, so that hot passages cost one row a chunk.

Defined results: null and empty texts have no words, and nothing is removed from fewer words than the
window; rows that repeat a doc_id don't remove each other, and each text of a repeated id is cut on its own; a null
doc_id neither removes nor is removed. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K

WINDOW = 50
ROUNDS = 4
#: Bits of a sieve: SPARSE for each row, 2 ** SIEVE (16 MB) at most; where more are marked, more windows are compared.
SPARSE, SIEVE = 16, 27
#: The column that tells different texts of one doc_id apart: a hash of the text.
ROW = "_row"


def parse(word: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the last round, with the first word of each one's context, the word after its last, and its number of words.

    A context that reaches over the document's edge isn't decided by words alone: it goes one beyond.
    """
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low_edge, high_edge = bounds[:-1] - 1, bounds[1:] + 1
    symbol, low, high, size = word, np.arange(len(word)), np.arange(1, len(word) + 1), np.ones(len(word), np.int64)

    def around() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context begin of the symbol before, context end of the symbol after; whether the next is in the same document."""
        same = doc[1:] == doc[:-1]
        before, after = low_edge[doc], high_edge[doc]
        before[1:] = np.where(same, low[:-1], before[1:])
        after[:-1] = np.where(same, high[1:], after[:-1])
        return before, after, same

    for r in range(rounds):
        if not len(symbol):
            break
        before, after, same = around()
        first = np.flatnonzero(np.concatenate([[True], ~(same & (symbol[1:] == symbol[:-1]))]))
        last = np.append(first[1:], len(symbol)) - 1
        length = (last - first + 1).astype(K.U64)
        low, high = np.minimum(low[first], before[first]), np.maximum(high[last], after[last])
        symbol = np.where(length == 1, symbol[first], K.mix(symbol[first] * K.U64(0x9FB21C651E98DF25) + length + K.U64(r)))
        doc, size = doc[first], np.add.reduceat(size, first)
        before, after, same = around()
        left = (K.mix(symbol + K.U64(1000 + r)) & K.U64(1)).astype(bool)
        paired = np.append(left[:-1] & ~left[1:] & same, False)
        second = np.concatenate([[False], paired[:-1]])
        low_new, high_new = low.copy(), high.copy()
        alone = ~paired & ~second
        low_new[alone & ~left] = np.minimum(low, before)[alone & ~left]
        high_new[alone & left] = np.maximum(high, after)[alone & left]
        at = np.flatnonzero(paired)
        low_new[at], high_new[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        name = symbol.copy()
        name[at] = K.mix(symbol[at] * K.U64(0xC2B2AE3D27D4EB4F) + symbol[at + 1] * K.U64(0x165667B19E3779F9) + K.U64(r))
        size = size.copy()
        size[at] += size[at + 1]
        keep = ~second
        symbol, low, high, doc, size = name[keep], low_new[keep], high_new[keep], doc[keep], size[keep]
    return symbol, low, high, size


def least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first:last] for every span; none is empty."""
    level = np.log2(last - first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    out, row = np.zeros(len(first), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):  # least of 1, 2, 4, 8, ... values from each one
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k)])
        row = np.concatenate([np.minimum(row[: -(1 << k)], row[1 << k :]), row[-(1 << k) :]])
    return out


def window_keys(word: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows and each one's key.

    The key of a window is the symbol of most words among those whose context it covers (ties: the least name), or else the
    least name of its words: equal windows have equal keys, and neighbouring windows mostly share theirs.
    """
    starts = np.flatnonzero(np.arange(len(word)) + window <= np.repeat(bounds[1:], np.diff(bounds)))
    symbol, low, high, size = parse(word, bounds)
    inside = (low >= 0) & (high <= len(word))
    doc = np.searchsorted(bounds, np.clip(low, 0, None), "right") - 1
    inside &= high <= bounds[np.minimum(doc + 1, len(bounds) - 1)]
    low, high = low[inside], high[inside]
    ranked = (K.U64(255) - np.minimum(size[inside], 255).astype(K.U64)) << K.U64(56) | symbol[inside] >> K.U64(8)  # most words first
    first, last = np.searchsorted(low, starts), np.searchsorted(high, starts + window, "right")
    has = last > first
    key = np.zeros(len(starts), K.U64)
    key[has] = least(ranked, first[has], last[has])
    key[~has] = least(word, starts[~has], starts[~has] + window)
    return starts, key.view(np.int64)


class _Runs:
    """The runs of a chunk: maximal stretches of windows of one document with one key. at: first words; n: windows; of: documents; a, b: hashes of all words."""

    def __init__(self, chunk: K.Chunk, window: int):
        self.word, self.bounds = chunk.hashes(), chunk.bounds
        start, key = window_keys(self.word, self.bounds, window)
        of = np.searchsorted(self.bounds, start, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(start) else np.zeros(0, np.int64)
        self.at, self.key, self.of, self.n = start[new], key[new], of[new], np.diff(np.append(new, len(start)))
        self.a, self.b = (K.spans_hash(self.word, self.at, self.at + self.n + window - 1, p).view(np.int64) for p in K._word_powers)


def _later(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of equal runs (a, b), those that don't stand in the first document of all these."""
    order = np.lexsort((doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.zeros(len(a), bool)
    out[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _parsed(window: int) -> Callable:
    names = ["doc", ROW, "at", "n", "key", "a", "b", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy() for c in ("doc", ROW))
            for chunk in K.chunks(batch.column("text")):
                runs = _Runs(chunk, window)
                doc, row = ids[chunk.first + runs.of], rows[chunk.first + runs.of]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, row, (runs.at - runs.bounds[runs.of]).astype(np.int32), runs.n.astype(np.int32), runs.key, runs.a, runs.b, _later(runs.a, runs.b, doc))], names=names)
                long = np.flatnonzero(chunk.counts >= window)  # whole documents, by their root names
                a, b = (K.spans_hash(runs.word, runs.bounds[long], runs.bounds[long + 1], p).view(np.int64) for p in K._word_powers)
                whole = np.full(len(long), -1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[chunk.first + long], rows[chunk.first + long], whole, chunk.counts[long].astype(np.int32), whole.astype(np.int64), a, b, np.zeros(len(long), bool))], names=names)

    return run


def sieve(marks: DataFrame) -> np.ndarray:
    """The words of 64 bits of a sieve of column `mark`, whose low bits are a place."""
    bits = min(max(6, math.ceil(math.log2(1 + SPARSE * marks.count()))), SIEVE)
    place = F.col("mark").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    words = marks.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(mark & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(K.U64)


def _hit(table: np.ndarray, mark: np.ndarray) -> np.ndarray:
    k = mark.view(K.U64) & K.U64(64 * len(table) - 1)
    return (table[(k >> K.U64(6)).astype(np.int64)] >> (k & K.U64(63)) & K.U64(1)).astype(bool)


def _windows(window: int, marked: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts = marked.value
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy() for c in ("doc", ROW))
            for chunk in K.chunks(batch.column("text")):
                runs = _Runs(chunk, window)
                hit = np.flatnonzero(_hit(keys, runs.key) & _hit(firsts, runs.a ^ ids[chunk.first + runs.of]))
                if len(hit):
                    n = runs.n[hit]
                    of = np.repeat(runs.of[hit], n)
                    at = np.repeat(runs.at[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    a, b = (K.window_hash(runs.word, at, window, second).view(np.int64) for second in (False, True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids[chunk.first + of]), pa.array(rows[chunk.first + of]), pa.array((at - runs.bounds[of]).astype(np.int32))], names=["a", "b", "doc", ROW, "at"])

    return run


def cut(text: str, begins: np.ndarray | None, lasts: np.ndarray | None, whole: bool, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words left when those of the windows that start from `begins` to `lasts` go."""
    words = (text or "").encode().split()
    n = len(words)
    if whole:
        return n, []
    if begins is None or not len(begins):
        return n, words
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, lasts + window, -1)
    return n, [w for w, gone in zip(words, (np.cumsum(step)[:n] > 0).tolist(), strict=True) if not gone]


def _cut(window: int, texts: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, begins, lasts, whole in zip(batch.column("text").to_pylist(), batch.column("begins"), batch.column("lasts"), batch.column("whole").to_pylist(), strict=True):
                n, kept = cut(text, *(x.values.to_numpy() if x.is_valid else None for x in (begins, lasts)), bool(whole), window)
                joined = b" ".join(kept)
                out.append((n, n - len(kept), joined.decode() if texts else hashlib.sha256(joined).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc, _row, begins, lasts): the first and last starts of each run of repeated windows; (doc, _row) that equal an earlier document as a whole."""
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"}).where("doc_id is not null").withColumnRenamed("doc_id", "doc").withColumn(ROW, F.xxhash64("text"))
    parsed = C.staged(texts.mapInArrow(_parsed(window), f"doc long, {ROW} long, at int, n int, key long, a long, b long, known boolean"), "parsed")
    whole = parsed.where("at < 0").select("a", "b", "n", "doc", ROW)
    classes = whole.groupBy("a", "b", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    gone = C.staged(C.join_sized(whole, C.staged(classes, "classes"), ["a", "b", "n"], "inner", F.lit(40)).where("doc > first").select("doc", ROW).distinct(), "gone")
    runs = parsed.where("at >= 0")
    by_key, by_run = Window.partitionBy("key"), Window.partitionBy("key", "a", "b")
    judged = runs.where("not known").repartition("key").sortWithinPartitions("key", "a", "b")
    judged = judged.withColumn("differ", (F.min("a").over(by_key) < F.max("a").over(by_key)) & (F.min("doc").over(by_key) < F.max("doc").over(by_key)))
    judged = judged.withColumn("later", F.col("doc") > F.min("doc").over(by_run)).where("later or differ")
    judged = C.staged(judged.select("doc", ROW, "at", "n", "key", "a", "later"), "judged")
    firsts = judged.where("not later")
    marks = [sieve(firsts.select(F.col("key").alias("mark")).distinct()), sieve(firsts.select(F.col("a").bitwiseXOR(F.col("doc")).alias("mark")))]
    marked = texts.sparkSession.sparkContext.broadcast(marks)
    windows = texts.mapInArrow(_windows(window, marked), f"a long, b long, doc long, {ROW} long, at int")
    windows = windows.withColumn("first", F.min("doc").over(Window.partitionBy("a", "b"))).where("doc > first").select("doc", ROW, "at", F.lit(1).alias("n"))
    hits = runs.where("known").select("doc", ROW, "at", "n").union(judged.where("later").select("doc", ROW, "at", "n")).union(windows)
    hits = hits.groupBy("doc", ROW).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    hits = C.join_sized(hits, gone, ["doc", ROW], "left_anti", F.lit(16))
    hits = hits.withColumn("s", F.expr("array_sort(array_distinct(flatten(transform(runs, x -> sequence(x.at, x.at + x.n - 1)))))"))
    begins, lasts = (F.expr(f"filter(s, (x, i) -> coalesce(get(s, i + {d}) <> x + {d}, true))") for d in (-1, 1))
    hits = C.staged(hits.select("doc", ROW, begins.alias("begins"), lasts.alias("lasts")), "hits")
    C.dropped(parsed, judged)
    return hits, gone


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): what is left of every document, as text or as its SHA-256."""
    C.arrow_rows(docs.sparkSession)
    hits, gone = repeated(docs, window)
    rows = C.rows_of(docs, {"doc_id": "long", "text": "string"}).withColumn(ROW, F.xxhash64("text"))
    marks = hits.join(gone.withColumn("whole", F.lit(True)), ["doc", ROW], "full").withColumnRenamed("doc", "doc_id")
    marks = C.staged(marks, "marks")
    both = C.join_sized(rows, marks, ["doc_id", ROW], "left", 32 + 8 * F.size(F.coalesce("begins", F.array().cast("array<int>"))))
    return both.select("doc_id", "text", "begins", "lasts", "whole").mapInArrow(_cut(window, texts), "doc_id long, n_words long, n_removed long, kept string")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(C.documents(spark, sf_dir), texts=False).withColumnRenamed("kept", "kept_sha256")


QUERIES: dict[str, Callable] = {"op6_repeats": op6_repeats}
