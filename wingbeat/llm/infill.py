"""Fill-in-the-middle transformation over a sparse exception index.

A text is cut into tokens (runs of A-Z and a-z, and every other code point by itself), and two seeded cuts between tokens
make a prefix, a middle and a suffix. Most texts go out in the order prefix, suffix, middle (psm), some as suffix, prefix,
middle (spm), each part behind its mark; the others stay plain.

Texts are handled as bytes. Of the code points only those of several bytes are recorded: their positions and the bytes
that they have in excess of one. Between them a code point's place is its byte's place less a constant, so a search in
the short list turns cuts in bytes into cuts in code points and back, and a text of ASCII needs no list at all.

Defined results: a null text counts as empty and stays plain; so do texts that hold one of the marks, since they could
not be told from the cuts. A null doc_id is hashed as an empty one. Rows that repeat a doc_id get the same cuts in
tokens, each in its own text. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are cut, and of these in the order spm.
CUT, SPM, SEED = 90, 20, "1"
BLOCK = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that a code point has in excess of one, by its first byte; -1 for bytes that go on with one.
_EXCESS = np.zeros(256, np.int8)
_EXCESS[0x80:0xC0], _EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:] = -1, 1, 2, 3


class Exceptions:
    """Of a text of UTF-8: the byte where each code point of several bytes begins, and the excess bytes up to and with it."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(_EXCESS[data] > 0)
        self.after = np.cumsum(_EXCESS[data[self.byte]], dtype=np.int64)

    def _excess(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        before = np.searchsorted(places, cuts, "left")
        return np.where(before > 0, self.after[before - 1], 0) if len(places) else np.zeros_like(cuts)

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each cut in bytes; cuts lie between code points."""
        return cuts - self._excess(self.byte, cuts)

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each cut in code points."""
        return cuts + self._excess(self.byte - np.concatenate([[0], self.after[:-1]]) if len(self.byte) else self.byte, cuts)


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the first bytes of tokens, of texts that stand one after the other."""
    letter = _LETTER[data]
    starts = _EXCESS[data] >= 0
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return starts


def nth(mask: np.ndarray, wanted: list[int]) -> list[int]:
    """Where the wanted-th (from 0) true places are, the mask's length where there are fewer; BLOCK places are listed at once."""
    out, seen = [len(mask)] * len(wanted), 0
    for at in range(0, len(mask), BLOCK):
        part = mask[at : at + BLOCK]
        n = int(np.count_nonzero(part))
        for i, k in enumerate(wanted):
            if seen <= k < seen + n:
                out[i] = at + int(np.flatnonzero(part)[k - seen])
        seen += n
    return out


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _cut(seed: str, cut: int, spm: int) -> Callable:
    def one(doc_id: int | None, text: np.ndarray, starts: np.ndarray, n: int) -> tuple[str, int | None, int | None, bytes]:
        """form, code points of prefix and middle, output; starts: mask of the first bytes of the text's n tokens."""
        h, whole = draws(doc_id, seed), text.tobytes()
        if not whole or h[2] % 100 >= cut or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
            return "plain", None, None, whole
        a, b = nth(starts, sorted((h[0] % (n + 1), h[1] % (n + 1))))
        chars = Exceptions(text).to_chars(np.array([a, b]))
        parts = {PREFIX: whole[:a], MIDDLE: whole[a:b], SUFFIX: whole[b:]}
        form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h[3] % 100 < spm else ("psm", (PREFIX, SUFFIX, MIDDLE))
        return form, int(chars[0]), int(chars[1] - chars[0]), b"".join(mark + parts[mark] for mark in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for chunk in K.chunks(batch.column("text")):
                at = chunk.byte_offsets
                starts = token_starts(chunk.data, at)
                mine, counts = ids[chunk.first : chunk.first + chunk.n], [int(np.count_nonzero(starts[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
                out = [one(mine[i], chunk.data[at[i] : at[i + 1]], starts[at[i] : at[i + 1]], counts[i]) for i in range(chunk.n)]
                form, prefix, middle, output = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(counts, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transformed(docs: DataFrame, seed: str = SEED, cut: int = CUT, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; n: its tokens."""
    C.arrow_rows(docs.sparkSession)
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"})
    return texts.mapInArrow(_cut(seed, cut, spm), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The marks stand nowhere else in it, so each is found at its first place."""
    p, s, m = (mark.decode() for mark in (PREFIX, SUFFIX, MIDDLE))
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(C.documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable] = {"op13_infill": op13_infill}
