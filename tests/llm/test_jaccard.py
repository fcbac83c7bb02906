"""The n-gram Jaccard join against brute force, with a large group of near copies about the threshold."""

import random

from wingbeat.llm import jaccard

DOC = "doc_id long, text string"


def plain(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {(i, len(s), top(i)) for i, s in sets.items()}


def about_the_threshold(n, seed=8):
    """Near copies of one text with so many words changed that some pairs link and others don't."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice((1, 2, 2, 3))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        if i % 7 == 0:
            w = w[: -rng.randrange(1, 6)]
        rows.append((i, " ".join(w)))
    return rows


def test_group_about_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 60)  # several tiles
    rows = about_the_threshold(260)
    want = plain(rows)
    assert 20 < len({c for *_, c in want}) < 240
    assert {tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, DOC)).collect()} == want


def test_tiles_alone(spark, monkeypatch):
    """Without pivot rounds all pairs of large groups are met in tiles."""
    monkeypatch.setattr(jaccard, "MOST_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "MANY", 4)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 30)
    rows = about_the_threshold(120, 9)
    assert {tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, DOC)).collect()} == plain(rows)


def test_tile_rows_are_sent_once(spark, monkeypatch):
    """Twice the documents of a group make twice the rows in its tiles, and few copies of tiles; pairs are lists of partners."""
    sizes = {}
    for n in (120, 240):
        with monkeypatch.context() as m:
            for name, value in {"MOST_ROUNDS": 0, "MANY": 4, "TILE_ROWS": 30, "SPREAD": 4}.items():
                m.setattr(jaccard, name, value)
            m.setattr(jaccard.C, "dropped", lambda *tables: None)
            made, whole, pairs = [], jaccard._tiles, jaccard._in_tiles
            m.setattr(jaccard, "_tiles", lambda *a: made.append(whole(*a)) or made[-1])  # noqa: B023
            m.setattr(jaccard, "_in_tiles", lambda *a: made.append(pairs(*a)) or made[-1])  # noqa: B023
            rows = about_the_threshold(n, 9)
            assert {tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, DOC)).collect()} == plain(rows)
            tiles = [len(r.rows) for r in made[0].collect()]
            sizes[n] = sum(tiles)
            assert len(tiles) > 20 and max(tiles) < 70
            lists = made[1].where("x is not null").collect()
            assert len(lists) < sum(len(r.ys) for r in lists)  # lists of partners, not pairs
    assert 1.5 < sizes[240] / sizes[120] < 2.6


def test_repeated_ids_are_one_document(spark):
    """Ids with several texts join their classes, whichever of them is the smallest."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(25)] + [None, "", "one"]
    rows = [(rng.randrange(40), rng.choice(texts)) for _ in range(70)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(i, []).append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    component = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in sets[i] for b in sets[j]):
                    component[i] = component[j] = min(component[i], component[j])
    got = jaccard.linked(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(component.items())
    some = spark.createDataFrame([(3, "a b c d e"), (5, "f g h i j"), (7, "a b c d e"), (7, "f g h i j"), (7, None)], DOC)
    assert {r.component_id for r in jaccard.linked(some).collect()} == {3}


def test_empty_and_clashing(spark):
    rows = [(None, "a b c d e"), (1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "One"), (6, "a b c d e"), (7, "A B c d e"), (8, "long " * 30000), (9, "long " * 20000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], DOC + ", token string, component int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.linked(df).collect())
    assert got == [(0, 2, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (8, 1, 8), (9, 1, 8)]
    assert jaccard.linked(df.limit(0)).count() == 0 and jaccard.one_of_each(df.limit(0)).count() == 0
    assert set(jaccard.one_of_each(df).columns) == set(df.columns)
