"""Cases that the docstrings define: neighbours, repeats and seats against plain loops."""

import random

from wingbeat.llm import mixing, neighbours, repeats


def plain_nearest(rows, every, k=10):
    """Of vectors of the most frequent length (of equally frequent ones the longer), the first of each id in array order."""
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v) and any(v)]
    lengths = [len(v) for _, v in good]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n))
    one = {}
    for i, v in good:
        if len(v) == usual:
            one[i] = min(one.get(i, v), v)
    out = set()
    for q, v in one.items():
        if q % every == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i) for i, w in one.items() if i != q)[:k]
            out |= {(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(near)}
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = random.Random(6)
    grid = [(i, [float(rng.randrange(3)), float(rng.randrange(3)), 1.0]) for i in range(60)]  # many ties
    odd = [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 1.0]), (104, [1.0, float("nan"), 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0, 2.0]), (20, [9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0])]
    rows = grid + odd
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.nearest(df, 10).collect()}
    assert got == plain_nearest(rows, 10)
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)"), 10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert neighbours.nearest(df.limit(0), 10).count() == 0


def test_repeats_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, "own " + text), (3, None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, n_words string, doc int")
    assert {(r.doc_id, r.n_words, r.n_removed) for r in repeats.without_repeats(df).collect()} == {(1, 60, 0), (2, 61, 60), (3, 0, 0)}
    assert repeats.without_repeats(df.limit(0)).count() == 0


def plain_seats(weights, total):
    """Seat by seat to the highest quotient; ties to the first."""
    won = [0] * len(weights)
    for _ in range(total if any(weights) else 0):
        won[max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_seats(spark):
    rng = random.Random(12)
    groups = {g: ([float(rng.choice((0, 1, 3, rng.randrange(1, 500)))) for _ in range(rng.randrange(1, 9))], rng.randrange(0, 60)) for g in range(25)}
    rows = [(g, i, w, total) for g, (weights, total) in groups.items() for i, w in enumerate(weights)]
    got = {(r.g, r.i): r.quota for r in mixing.seats(spark.createDataFrame(rows, "g int, i int, w double, total long"), ["g"], ["i"], "w", "total").collect()}
    for g, (weights, total) in groups.items():
        assert [got[g, i] for i in range(len(weights))] == plain_seats(weights, total), g


def test_repeats_with_a_full_sieve(spark, monkeypatch):
    """Where all bits of the sieve are marked, all windows are verified, with the same result; runs of windows come back as their ends."""
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, text), (2, "a b " + " ".join(text.split()[:55]) + " c d " + " ".join(text.split()[60:]) + " e"), (3, None), (4, text), (5, " ".join(f"x{i}" for i in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (repeats.SIEVE, 6):
        monkeypatch.setattr(repeats, "SIEVE", bits)
        assert {(r.doc_id, r.n_words, r.n_removed) for r in repeats.without_repeats(df).collect()} == {(1, 120, 0), (2, 120, 115), (3, 0, 0), (4, 120, 120), (5, 90, 0)}
    hits, gone = repeats.repeated(df)
    assert [(r.doc, r.begins, r.lasts) for r in hits.collect()] == [(2, [2, 59], [7, 69])] and [r.doc for r in gone.collect()] == [4]
