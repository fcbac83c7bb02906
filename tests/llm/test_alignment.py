"""Alignment against encoding whole texts by ids alone, and counts against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingbeat.llm import alignment as L

PARTS = ["a", "B", "c", " ", "  ", "\n", "\t", ".", ",", "'", "1", "é", "😀", "ñ", "中", "文", "ß", "́", "ﬁ", "\x1c", "\x85", "​", "　", "▁", " the", "ing ", "<|endoftext|>", "<s>", "</s>", "'s", " don't", "日本", "0x41", "<0x41>"]


@pytest.fixture(scope="module")
def e():
    return L.encoders(f"{L.FOLDER}/{L.A}", f"{L.FOLDER}/{L.B}")


def plain(e, text):
    """By decoded bytes alone, token by token, of the whole text."""
    if not text:
        return 0, 0, 0, "", Counter()
    spaced = (" " + text).encode()
    sides = []
    for ids, table in ((e.a.encode(" " + text, add_special_tokens=False).ids, e.a_bytes), (e.b.encode(text), e.b_bytes)):
        if b"".join(table[i] for i in ids) != spaced:
            return 0, 0, 0, "", Counter()
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at + len(table[i])))
            at += len(table[i])
        sides.append(tokens)
    a, b = sides
    both = sorted({t[2] for t in a} & {t[2] for t in b})
    groups = ["|".join(",".join(str(i) for i, _, end in s if low < end <= high) for s in (a, b)) for low, high in zip([0, *both], both)]
    links, j = Counter(), 0
    for i, s, t in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < t:
            links[i, b[k][0]] += 1
            k += 1
    return len(a), len(b), len(groups), ";".join(groups), links


def test_listed(e):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    memory = L.Memory(e)
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        sums, groups, pairs, times, bounds = L._listed(memory, some)
        for i, t in enumerate(some):
            mine = slice(bounds[i], bounds[i + 1])
            links = Counter({(p // L.IDS, p % L.IDS): n for p, n in zip(pairs[mine].tolist(), times[mine].tolist())})
            assert (*(int(x[i]) for x in sums), groups[i], links) == plain(e, t), t


def test_memory_is_emptied(e, monkeypatch):
    monkeypatch.setattr(L, "WORDS", 3)
    memory = L.Memory(e)
    for text in ("one two three four five", "six one two", "", "seven one"):
        sums, groups, *_ = L._listed(memory, [text])
        assert groups[0] == plain(e, text)[3]
    assert len(memory.number) < 9


def test_refined():
    coarse = np.array([[0, 2], [2, 5], [2, 5], [5, 6], [6, 6], [6, 6], [6, 9]])
    assert L.refined(coarse, np.array([2, 2, 1, 1, 1, 1, 1])).tolist() == [2, 4, 5, 6, 7, 8, 9]


TEXTS = [None, "", "the cat", "the cat sat", "a ▁ b", "é😀 中文 中文", "word " * 20_000, "x" * 30_000, "the cat", "don't stop</s>", "\n", " "]


@pytest.fixture
def docs(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat", 5, "x"), (3, "another one", 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_op12(spark, docs, e, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(L.C.join_sized, "__defaults__", (limit,))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], plain(e, r["text"])) for r in docs.collect()]
    count = Counter(p for _, x in rows for p in x[4])
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for i, (n_a, n_b, n_groups, groups, links) in rows:
        digest = L.infill.hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        want.append((i, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), digest))
    out = L.op12_alignment(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_empty(spark, docs, tmp_path):
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert L.op12_alignment(spark, str(tmp_path)).count() == 0


def test_memory_grows_in_place(e):
    """New words are added to what is known without a copy of it, but for a few doublings."""
    memory, held = L.Memory(e), set()
    for i in range(0, 6000, 20):
        memory.words([" ".join(f"word{k}" for k in range(i, i + 20))])
        held.add(memory.held["links"].held.ctypes.data)
    known = memory.known
    assert len(held) < 12 and len(known.groups) == len(known.n_a) == len(memory.number) == 6000
    for w in ("word0", "word19", "word5999"):
        n = memory.number[w]
        assert known.groups[n] == plain(e, w)[3] and known.at[n + 1] - known.at[n] == sum(plain(e, w)[4].values())
