"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another.

Tokenizer A is read by `tokenizers` from a JSON file of a byte-level BPE, B by `sentencepiece` from a model with byte
fallback. A encodes a space and the text, B the text, before which it sets a space itself; special tokens are neither
added nor recognised.

Spans: the libraries' own spans (character offsets of A, byte spans of B's offset mapping) are coarse cuts. Where they give each
token its own stretch they are taken as they are; where tokens share a character (pieces of one that has several bytes,
byte-fallback tokens) the bytes that the tokens decode to refine them. The bytes where tokens of both end cut a text into
groups, in which every two tokens whose bytes overlap are linked.

No token of either goes beyond a single space between two other characters: A's pre-tokenizer begins a new one there,
and B's model has no piece that goes on after a word with a space (checked when it is loaded; else texts are encoded
whole). So texts are encoded by such words, each with the space before it, and a worker remembers the alignments of the
words it saw. Results are those of whole texts (tested).

Counts over documents: each document lists its distinct linked id pairs with how often it links them; these are
written once, counted by pair, and joined back, broadcast only if they measure little.

Defined results: a text that is null or empty, or whose tokens don't decode to a space and the text (as where B
normalises), has no tokens: zeros and no groups. Rows that repeat a doc_id are documents of their own; a null doc_id
stays null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import infill
from . import tokens as K

FOLDER, A, B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A worker forgets its words when it holds more than so many of them, or of their links: some 300 MB. Bounds memory only.
WORDS, LINKS = 1 << 20, 1 << 23
#: New words encoded at once.
TOGETHER = 4096
#: A pair's code: the id of A times this, plus that of B.
IDS = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def refined(coarse: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ends of tokens in bytes. coarse: rows (begin, end) of the libraries' spans, also in bytes; length: decoded bytes.

    Tokens whose spans have other lengths than their bytes share characters; runs of such tokens are refined by their
    bytes, from where the token before them ends.
    """
    ends = coarse[:, 1].copy()
    shared = np.flatnonzero(coarse[:, 1] - coarse[:, 0] != length)
    if len(shared):
        run = np.concatenate([[True], np.diff(shared) > 1])
        first = shared[run]
        total = np.cumsum(length[shared])
        before = (total - length[shared])[run]
        base = np.where(first > 0, ends[first - 1], 0) - before
        ends[shared] = total + np.repeat(base, np.diff(np.append(np.flatnonzero(run), len(shared))))
    return ends


def _two_columns(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


class Encoders:
    """Both tokenizers, of a task."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letter = byte_of_letter()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        #: Ids as text, each with what follows it: A's within a group and as its last, then B's.
        ends = [(len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";")]
        self.written = np.array([f"{i}{end}" for n, end in ends for i in range(n)], object)
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)

    def spans_a(self, text: str, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and coarse spans, in bytes, of a text with its space."""
        found = self.a.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), infill.Exceptions(data).to_bytes(_two_columns(found.offsets))

    def spans_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As spans_a; text: without the space that B adds, which has no place in its spans."""
        found = self.b.encode(text.encode(), return_type="offset_mapping")
        coarse = _two_columns(found["offsets"]) + 1
        coarse[:1, 0] = 0
        return np.array(found["ids"], np.int64), coarse


@functools.cache
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


class Alignments:
    """Of some texts: numbers of tokens and groups, the groups as text, the codes of links (those of text i: links[at[i]:at[i + 1]]); n_a 0: no tokens."""

    def __init__(self, n: int = 0) -> None:
        """Of n texts without tokens."""
        self.n_a = self.n_b = self.n_groups = np.zeros(n, np.int64)
        self.groups: list[str] = [""] * n
        self.links, self.at = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)

    @classmethod
    def of(cls, parts: list[Alignments]) -> Alignments:
        out = cls()
        for name in ("n_a", "n_b", "n_groups", "links"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in parts]))
        out.groups = [g for x in parts for g in x.groups]
        out.at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x.at) for x in parts]))])
        return out


def alignments(e: Encoders, texts: list[str]) -> Alignments:
    """Of texts that aren't empty; more than one only if they may be cut from one text, a space before each.

    They are encoded and aligned as one. If its tokens decode to other bytes, halves are tried, until the texts are found that have no tokens.
    """
    text = " ".join(texts)
    spaced = f" {text}"
    raw = spaced.encode()
    data = np.frombuffer(raw, np.uint8)
    (a, a_coarse), (b, b_coarse) = e.spans_a(spaced, data), e.spans_b(text)
    if any(b"".join(map(table.__getitem__, ids.tolist())) != raw for table, ids in ((e.a_bytes, a), (e.b_bytes, b))):
        half = len(texts) // 2
        return Alignments.of([alignments(e, texts[:half]), alignments(e, texts[half:])]) if half else Alignments(1)
    a_ends, b_ends = refined(a_coarse, e.a_length[a]), refined(b_coarse, e.b_length[b])
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    stops = np.cumsum(np.fromiter(map(len, map(str.encode, texts)), np.int64, len(texts)) + 1)
    # how many tokens of A and of B, and common ends, stand up to the end of each text
    upto = [np.concatenate([[0], np.searchsorted(x, stops, "right")]) for x in (a_ends, b_ends, both)]
    out = Alignments()
    out.n_a, out.n_b, out.n_groups = (np.diff(x) for x in upto)
    # the ids of a group's A tokens come before those of its B tokens; its last A token and its last B token end otherwise
    a_upto, b_upto = np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")
    a_of, b_of = (np.repeat(np.arange(len(both)), np.diff(x, prepend=0)) for x in (a_upto, b_upto))
    n_a, n_b = len(e.a_bytes), len(e.b_bytes)
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.concatenate([[0], b_upto])[a_of]] = a + n_a * np.isin(np.arange(len(a)), a_upto - 1, assume_unique=True)
    code[np.arange(len(b)) + a_upto[b_of]] = b + 2 * n_a + n_b * np.isin(np.arange(len(b)), b_upto - 1, assume_unique=True)
    written = e.written[code].tolist()
    cut = (upto[0] + upto[1]).tolist()
    out.groups = ["".join(written[i:j])[:-1] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    # a token of A overlaps those of B from the one that holds its first byte to the one that holds its last
    begins = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, begins, "right")
    n = np.searchsorted(b_ends, a_ends, "left") - first + 1
    of_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    out.links = np.repeat(a, n) * IDS + b[of_b]
    out.at = np.concatenate([[0], np.cumsum(n)])[upto[0]]
    return out


class _Grown:
    """An array that grows in place, by doubling."""

    def __init__(self, first: int | None = None):
        self.held, self.n = np.zeros(1024, np.int64), 0
        if first is not None:
            self.add(np.array([first]))

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(self.n + len(more), np.int64)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def now(self) -> np.ndarray:
        return self.held[: self.n]


class Memory:
    """The alignments of words seen, by number; emptied when they are many."""

    def __init__(self, e: Encoders):
        self.e = e
        self._emptied()

    def _emptied(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = {name: _Grown() for name in ("n_a", "n_b", "n_groups", "links")} | {"at": _Grown(0)}

    @property
    def known(self) -> Alignments:
        out = Alignments()
        out.n_a, out.n_b, out.n_groups, out.links, out.at = (self.held[name].now for name in ("n_a", "n_b", "n_groups", "links", "at"))
        out.groups = self.groups
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, and how many each has."""
        if len(self.number) > WORDS or self.held["links"].n > LINKS:
            self._emptied()
        split = [(_CUT.split(t) if self.e.by_word else [t]) if t else [] for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.number)
        # words that begin or end with white space, as a text's first and last may, can't stand between others
        joined = [w for w in fresh if self.e.by_word and not (w[0].isspace() or w[-1].isspace())]
        alone = list(fresh.difference(joined))
        for some in [*(joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)), *([w] for w in alone)]:
            new = alignments(self.e, some)
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            self.groups += new.groups
            self.held["at"].add(new.at[1:] + self.held["links"].n)
            for name in ("n_a", "n_b", "n_groups", "links"):
                self.held[name].add(getattr(new, name))
        n = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, n.sum()), n


@functools.cache
def memory(a_path: str, b_path: str) -> Memory:
    """One for each Python worker, whatever tasks it runs."""
    return Memory(encoders(a_path, b_path))


def _listed(words: Memory, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text n_a, n_b and n_groups, and its groups; then the pairs of all, how often each is linked, and the bounds of each text's."""
    word, n = words.words(texts)
    known = words.known
    doc = np.repeat(np.arange(len(texts)), n)
    none = np.bincount(doc[known.n_a[word] == 0], minlength=len(texts)) > 0
    word, doc = word[~none[doc]], doc[~none[doc]]
    sums = [np.bincount(doc, x[word], len(texts)).astype(np.int64) for x in (known.n_a, known.n_b, known.n_groups)]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    named = [known.groups[w] for w in word.tolist()]
    groups = [";".join(named[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    long = known.at[word + 1] - known.at[word]
    place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(known.at[word], long)
    keys, often = np.unique(np.repeat(doc, long) * (IDS * IDS) + known.links[place], return_counts=True)
    return sums, groups, keys % (IDS * IDS), often, np.searchsorted(keys // (IDS * IDS), np.arange(len(texts) + 1))


def _aligned(a_path: str, b_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memory(a_path, b_path)
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                at = chunk.byte_offsets.tolist()
                texts = [chunk.data[i:j].tobytes().decode() for i, j in zip(at[:-1], at[1:], strict=True)]
                sums, groups, pairs, times, bounds = _listed(words, texts)
                size = pa.array(bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(size, pa.array(pairs)), pa.ListArray.from_arrays(size, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, chunk.n), *(pa.array(x) for x in sums), pa.array(groups, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    return run


def aligned(docs: DataFrame, folder: str = FOLDER, a_file: str = A, b_file: str = B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times) of every document.

    groups: ids of A and B as `a1,a2|b1;a3|b2,b3`; pairs: its distinct linked pairs (A's id * IDS + B's), times: how
    often it links each. The folder must be on every executor.
    """
    C.arrow_rows(docs.sparkSession)
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"})
    return texts.mapInArrow(_aligned(f"{folder}/{a_file}", f"{folder}/{b_file}"), "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many rows of `listed` (pairs) each pair stands, and whether no pair of its A id stands in more."""
    counts = C.staged(listed.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    a = F.floor(F.col("pair") / F.lit(IDS))
    most = C.staged(counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most")), "most")
    both = C.join_sized(counts.withColumn("a", a), most, "a", "inner", F.lit(24))
    return both.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def counted(listed: DataFrame) -> DataFrame:
    """(row, n_links, n_best, count_sum) of a written table (row, pairs, times) with any links."""
    counts = C.staged(pair_counts(listed), "counts")
    flat = listed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    met = C.join_sized(flat, counts, "pair", "inner", F.lit(48))
    return met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(C.documents(spark, sf_dir))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    listed = C.staged(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    sums = ("n_links", "n_best", "count_sum")
    out = listed.drop("pairs", "times").join(counted(listed), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums], "groups_sha256")


QUERIES: dict[str, Callable] = {"op12_alignment": op12_alignment}
