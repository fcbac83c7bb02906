"""Fill-in-the-middle: exact round trips, plain cuts by regular expression, and the exception index against slices."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wingbeat.llm import infill


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<PSM> é中😀\n"), max_size=40))
def test_exceptions(text):
    raw = text.encode()
    index = infill.Exceptions(np.frombuffer(raw, np.uint8))
    chars = np.arange(len(text) + 1)
    in_bytes = np.array([len(text[:i].encode()) for i in chars])
    assert index.to_bytes(chars).tolist() == in_bytes.tolist()
    assert index.to_chars(in_bytes).tolist() == chars.tolist()
    assert len(index.byte) == sum(len(c.encode()) > 1 for c in text)


def test_nth(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 4)
    mask = np.array([1, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0], bool)
    assert infill.nth(mask, [0, 1, 2, 3, 4]) == [0, 3, 8, 9, 11]


def test_transformed(spark):
    rnd = random.Random(1)
    texts = [None, "", "<", "a", "é", "ab<P>cd", "x <S", "<M", "S>P>M>" * 9, "word " * 30_000, "中" * 5000, "\n\t a1b2", "zé" * 70_000] + ["".join(rnd.choice(["<", "P", "S>", "M", "word", " ", "é", "😀", "<P", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 1), (7, "again and again", "", 1), (7, "again and again", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = infill.transformed(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    told = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out), key=str)
    assert told == sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=str)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert infill.transformed(docs.limit(0)).count() == 0
