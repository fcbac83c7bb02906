"""The text operators against plain versions, with nulls, empty texts, repeats and ties."""

import random

import pytest
from pyspark.sql import functions as F

from wingbeat.llm import html, jaccard, mixing, neighbours, pii, repeats

DOC = "doc_id long, text string, source string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}"
    base = [[word() for _ in range(rng.randrange(60, 160))] for _ in range(30)]
    rows = [(i, " ".join(w), f"s{i % 4}", 0) for i, w in enumerate(base)]
    for i in range(30, 60):
        w = list(base[i % 30])
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " \n".join(w[:20]) + " " + " ".join(w[20:]), None if i % 5 == 0 else "s1", 0))
    rows += [(60, None, "s0", 0), (61, "", "s0", 0), (62, "one two", "s2", 0), (63, "one two", "s2", 0), (64, "x " * 70, "s3", 0), (65, "x " * 90, "s3", 0), (5, rows[5][1], "s1", 0)]
    return spark.createDataFrame(rows, DOC), rows


def test_repeats(docs):
    df, rows = docs
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = (t or "").split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = set()
    for i, t, *_ in rows:
        w = (t or "").split()
        gone = {j + k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(50)}
        want.add((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert {tuple(r) for r in repeats.without_repeats(df).collect()} == want


def test_repeats_of_one_id(spark):
    long, short = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(55))
    rows = [(1, long), (2, long), (2, short), (2, "x " + short), (3, long + " end"), (3, short), (3, None), (None, long), (4, "few words")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 120, 0), (2, 120, 120), (2, 55, 0), (2, 56, 0), (3, 121, 120), (3, 55, 55), (3, 0, 0), (0, 120, 0), (4, 2, 0)])


def test_jaccard(docs):
    df, rows = docs
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert {tuple(r) for r in jaccard.linked(df).collect()} == {(i, len(s), top(i)) for i, s in sets.items()}


def test_mixing(docs):
    df, rows = docs
    out = mixing.mixed(mixing.sizes(df), block=4, shard_words=500).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(a - b) <= 4 for a, b in by.values())
    assert mixing.mixed(mixing.sizes(df.limit(0))).count() == 0


def test_pii(spark):
    text = "é a.b@c.de call +1 (132) 555-1352 ip 1.2.3.4 or 999.1.1.1 card 4929348385146306 x"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found if x.strict] for r in pii.spans(df).collect()}
    at = lambda s: (text.index(s), text.index(s) + len(s))
    assert set(got[1]) == {("email", *at("a.b@c.de")), ("phone", *at("+1 (132) 555-1352")), ("ip", *at("1.2.3.4")), ("card", *at("4929348385146306"))}
    assert got[2] == got[3] == []
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[1].startswith("é [email] call [phone] ip [ip] or") and masked[2] is None and masked[3] == ""


def test_html(spark):
    page = "<body><nav>Menu</nav><div>Same line</div><div id=c><p>Text {0} &amp; more<br>here<p>Second {0}</div><div class='comments'>no</div><script>if(a<b){{}}</script></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(20)] + [(20, None, None), (21, "x", "")]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Text 7 & more here\n\nSecond 7" and got[20] == got[21] == ""


def test_neighbours(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, None)]
    v = dict(rows[:300])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hit = n = 0
    out = neighbours.nearest(df, 20).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()
    assert len(out) == 15
    for r in out:
        d = sorted((sum((a - b) ** 2 for a, b in zip(v[r.query_id], v[i], strict=True)), i) for i in v if i != r.query_id)
        hit, n = hit + len({i for _, i in d[:10]} & set(r.ids)), n + 10
    assert hit / n >= 0.9
