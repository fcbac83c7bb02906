"""URL filters: a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL: a point, the host with A-Z in lower case, the path, and the query with its
`?`; scheme and fragment are left out. `*` is any run of bytes but / and ?, `**` any run at all, all else stands for itself.
A rule of host and path (`example.org/es/`) is the glob `*.example.org/es/**`, which fits the host and its subdomains
and paths that start alike, as `*` can't leave the host.

The rules' states stand side by side in one multiword bit mask (extended Shift-And, Navarro and Raffinot): one bit for
each number of bytes matched. A byte shifts all states at once, masked by the rules' next bytes, and states before a
wildcard stay. All URLs of a batch take a step together, in numpy, as long as more than FEW have bytes left; the rest of
these is read one by one with the same masks as integers. Memory is the number of URLs times the words of the mask.

Of the host-and-path rules that fit, the longest wins (as text; of equally long ones a block). Where none fits, a URL
that any glob of `globs` fits is blocked, and the others get `default`.

Defined results: a null url, and one without `://`, has an empty host and path and meets no rule, so that it gets
`default`. A url without a path has an empty path, which no rule of host and path fits. Repeated rows are judged one by
one; an empty table gives an empty result; extra columns are ignored, also those named like a result.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K

#: (verdict, host/path) of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts and addresses that no training text is taken from, where no rule of host and path fits.
GLOBS = (
    "*casino**", "*free-bets**", "*poker-**", "*cheap-pills**", "*pharma-**", "*adult-**", "*.xxx/**", "*porn**",
    "*spam-**", "*ads-track**", "*.ads.*/**", "*adserver**", "**/wp-login.php**", "**/wp-admin/**", "**/cgi-bin/**",
    "**?*sessionid=**", "**.exe", "**.zip", "**.iso",
)

#: So few URLs of a batch are read on one by one: numpy's steps would cost more.
FEW = 16

U64, BITS = np.uint64, 64
_SOME, _ANY = 1, 2  # what a state may stay on: bytes but / and ?, all bytes


def parsed(glob: str) -> tuple[list[int], list[int]]:
    """The bytes that a glob asks for and, before each and after the last, which runs it admits."""
    want, stay = [], [0]
    for byte in glob.encode():
        if byte == ord("*"):
            stay[-1] = _ANY if stay[-1] else _SOME
        else:
            want.append(byte)
            stay.append(0)
    return want, stay


class Automaton:
    """The masks of some globs: step[c] and stay[c] are words for byte c; start and final have a bit for each glob."""

    def __init__(self, globs: list[str]):
        shapes = [parsed(g) for g in globs]
        first = np.cumsum([0] + [len(want) + 1 for want, _ in shapes])
        self.n, self.words = len(globs), max(1, -(-int(first[-1]) // BITS))
        self.step, self.stay = np.zeros((256, self.words), U64), np.zeros((256, self.words), U64)
        self.start = np.zeros(self.words, U64)
        self.final = [(int(b - 1) // BITS, U64(int(b - 1) % BITS)) for b in first[1:]]
        some = np.setdiff1d(np.arange(256), [ord("/"), ord("?")])
        for at, (want, stay) in zip(first, shapes):
            self.start[at // BITS] |= U64(1) << U64(at % BITS)
            for j, byte in enumerate(want):
                self._set(self.step, [byte], at + j + 1)
            for j, kind in enumerate(stay):
                if kind:
                    self._set(self.stay, some if kind == _SOME else range(256), at + j)
        self.steps, self.stays = ([int.from_bytes(row.tobytes(), "little") for row in m] for m in (self.step, self.stay))

    @staticmethod
    def _set(masks: np.ndarray, of: list[int] | np.ndarray | range, bit: int) -> None:
        masks[list(of), bit // BITS] |= U64(1) << U64(bit % BITS)

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each glob fits each string of bytes data[offsets[i]:offsets[i + 1]], from its start to its end."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, longest = offsets[:-1][order], length[order]
        now = np.tile(self.start, (len(order), 1))
        together = longest[FEW] if len(longest) > FEW else 0
        for p, k in enumerate(np.searchsorted(-longest, -np.arange(together), "left").tolist()):  # k rows have more bytes than p
            c, d = data[begin[:k] + p], now[:k]
            up = d << U64(1)
            up[:, 1:] |= d[:, :-1] >> U64(BITS - 1)
            now[:k] = up & self.step[c] | d & self.stay[c]
        for i in np.flatnonzero(longest > together).tolist():
            d = int.from_bytes(now[i].tobytes(), "little")
            for byte in data[begin[i] + together : begin[i] + longest[i]].tobytes():
                d = d << 1 & self.steps[byte] | d & self.stays[byte]
            now[i] = np.frombuffer(d.to_bytes(self.words * BITS // 8, "little"), U64)
        out = np.zeros((len(order), self.n), bool)
        for i, (word, bit) in enumerate(self.final):
            out[order, i] = (now[:, word] >> bit) & U64(1) != 0
        return out


def rule_glob(rule: str) -> str:
    """The glob of host/path; neither part may hold what a glob or the cut of a URL reads otherwise."""
    host, slash, path = rule.partition("/")
    if not host or not slash or set(rule) & set("*?#") or host != host.lower():
        raise ValueError(f"no rule of host and path: {rule!r}")
    return f"*.{host}/{path}**"


def canonical(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, address) of every row."""
    rows = C.rows_of(pages, {"page_id": "long", "url": "string"})
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", i), F.lit(""))
    rows = rows.select("page_id", F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase).alias("host"), part(2).alias("path"), part(3).alias("query"))
    return rows.select("page_id", "host", "path", F.concat(F.lit("."), "host", "path", "query").alias("address"))


def _judged(rules: tuple[tuple[str, str], ...], globs: tuple[str, ...], default: str) -> Callable:
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    automaton = Automaton([rule_glob(text) for _, text in ranked] + list(globs))
    text, verdict = (np.array([*[r[k] for r in ranked], None], object) for k in (1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = automaton.fits(*K.text_buffers(batch.column("address")))
            listed = np.column_stack([fits[:, : len(ranked)], np.ones(len(fits), bool)])
            best = listed.argmax(axis=1)
            other = np.where(fits[:, len(ranked) :].any(axis=1), "block", default)
            told = np.where(best < len(ranked), verdict[best], other)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(text[best], pa.string()), pa.array(told, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, globs: tuple[str, ...] = GLOBS, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url)."""
    C.arrow_rows(pages.sparkSession)
    return canonical(pages).mapInArrow(_judged(rules, globs, default), "page_id long, host string, path string, rule string, verdict string")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable] = {"op11_url_filter": op11_url_filter}
