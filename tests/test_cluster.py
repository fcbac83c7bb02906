"""Clustering and scaling of a recording's regions against plain versions; small cases of sampling and sources."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wingbeat.operators import augment, balance, cluster
from wingbeat.sources import io


def plain_clusters(x, eps, least):
    near = [[j for j in range(len(x)) if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= eps] for i in range(len(x))]
    core = [len(n) >= least for n in near]
    label, k = [-1] * len(x), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = k
                todo += near[j] if core[j] else []
        k += 1
    return label


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b)) and all((x < 0) == (y < 0) for x, y in zip(a, b, strict=True))


def test_cluster_events(spark):
    rng = random.Random(4)
    rows = [(f"r{k}", i, centre + rng.gauss(0, 0.2), centre + rng.gauss(0, 0.2)) for k in range(3) for i in range(40) for centre in [rng.choice((0.0, 5.0, 9.0))]]
    rows += [("r0", 100, 50.0, 50.0), ("r0", 101, None, 1.0), ("few", 1, 0.0, 0.0), ("few", 2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "recording string, roi_no int, a double, b double")
    got = {(r.recording, r.roi_no): (r.cluster, r.keep_label) for r in cluster.cluster_events(df, ["a", "b"], 1.0, 5.0).collect()}
    assert ("r0", 101) not in got and got["few", 1] == got["few", 2] == (-1, 0)
    for k in range(3):
        mine = sorted((r for r in rows if r[0] == f"r{k}" and r[2] is not None), key=lambda r: r[1])
        x = np.array([r[2:] for r in mine])
        labels = [got[r[0], r[1]][0] for r in mine]
        assert same_parts(labels, plain_clusters(x, 1.0, max(2, round(0.05 * len(x)))))
        largest = max(labels.count(c) for c in labels if c >= 0)
        assert sum(got[r[0], r[1]][1] for r in mine) == largest


def _sets():
    """Named recordings of rows (roi_no, features): blobs with noise and copies, lines, one place alone, three features."""
    rng = random.Random(9)
    blobs = [(rng.choice((0.0, 3.0, 9.0)) + rng.gauss(0, 0.3), rng.choice((0.0, 5.0)) + rng.gauss(0, 0.3), 1.0) for _ in range(260)] + [(rng.uniform(-20, 20), rng.uniform(-20, 20), 1.0) for _ in range(30)]
    copies = [(1.0, 1.0, 1.0)] * 150 + [(1.5, 1.0, 1.0)] * 3 + [(9.0, 9.0, 1.0)] * 2 + [(7.0, 1.0, 2.0)]
    lines = [(0.4 * i, 0.0, 0.0) for i in range(90) if i % 29] + [(0.4 * i, 0.9, 0.0) for i in range(90) if i % 13]
    cube = [tuple(rng.gauss(0, 1) for _ in range(3)) for _ in range(200)]
    sets = {"blobs": blobs, "copies": copies, "lines": lines, "cube": cube, "one": [(2.0, 2.0, 2.0)] * 5, None: blobs[:100], "two": blobs[:2]}
    return {name: list(enumerate(rng.sample(rows, len(rows)))) for name, rows in sets.items()}


def _clustered(spark, sets, eps, pct):
    flat = [(name, i, *x) for name, rows in sets.items() for i, x in rows]
    out = cluster.cluster_events(spark.createDataFrame(flat, "recording string, roi_no int, a double, b double, c double"), ["a", "b", "c"], eps, pct)
    return {(r.recording, r.roi_no): (r.cluster, r.keep_label) for r in out.collect()}, len(flat), out.count()


@pytest.mark.parametrize("eps", [0.7, "auto"])
def test_grid_equals_one_task(spark, monkeypatch, eps):
    sets = _sets()
    plain, n, rows = _clustered(spark, sets, eps, 3.0)
    for name, value in {"SMALL": 2, "TILE": 8, "SPREAD": 2, "PAIRS": 300}.items():
        monkeypatch.setattr(cluster, name, value)
    told, _, again = _clustered(spark, sets, eps, 3.0)
    assert told == plain and n == rows == again == len(told)
    assert len({c for c, _ in told.values()}) > 3
    for name, rows in sets.items():
        if eps != "auto" and len(rows) > 2:
            x = np.array([x for _, x in rows])
            assert [told[name, i][0] for i, _ in rows] == plain_clusters(x, eps, max(2, round(0.03 * len(x))))


def test_a_large_recording_is_spread(spark, monkeypatch):
    """Tiles of a crowded cell meet in several groups; none holds the whole recording."""
    rng = random.Random(2)
    for name, value in {"TILE": 16, "SPREAD": 2}.items():
        monkeypatch.setattr(cluster, name, value)
    rows = [("r", i, [rng.random(), rng.random()], 1, 0.0, i) for i in range(1000)]
    vectors = spark.createDataFrame(rows, "recording string, roi_no int, x array<double>, w long, tag double, point long")
    grid = spark.createDataFrame([("r", [0.0, 0.0], [1, 2], 0.5, 0.5)], "recording string, low array<double>, axes array<int>, width double, eps double")
    cells = cluster._Grid(vectors, grid, 2)
    sizes = [len(r.point) for r in cells._tiles(cells.rows).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 48 and len(sizes) > 40
    near = {r.point: r.n for r in cells.met("count").groupBy("point").agg(F.sum("value").alias("n")).collect()}
    x = np.array([r[2] for r in rows])
    assert [near[i] for i in range(1000)] == (np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.5).sum(axis=1).tolist()


def test_rows_left_out(spark):
    rows = [("r", i, float(i % 3)) for i in range(12)] + [("r", 90, None), ("r", 91, float("nan")), ("r", 92, float("inf"))]
    got = cluster.cluster_events(spark.createDataFrame(rows, "recording string, roi_no int, a double"), ["a"], 0.1, 5.0)
    assert sorted(r.roi_no for r in got.collect()) == list(range(12))
    assert cluster.cluster_events(spark.createDataFrame(rows, "recording string, roi_no int, a double").limit(0), ["a"]).count() == 0


def test_robust_scaling(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 7.0)], "recording string, x double")
    got = sorted((r.x, r.x_scaled) for r in cluster.scale_features(df, [], ["x"], "robust").collect())
    assert [round(s, 9) for _, s in got] == [-1, round(-1 / 3, 9), round(1 / 3, 9), 1, 0]
    q = statistics.quantiles([1, 2, 3, 4], n=4, method="inclusive")
    assert (q[0] - q[1], q[2] - q[1]) == (-0.75, 0.75)


def test_mix_pairs_of_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, float(i)], [1.0, 0.0]) for i in range(12)], "row_id long, samples array<double>, labels array<double>")
    out = augment.mix_pairs(df, p=1.0).collect()
    assert all(r.partner is not None and r.partner != r.row_id for r in out) and len({r.partner for r in out}) == 12
    assert augment.mix_pairs(df.limit(1), p=1.0).first().samples == df.limit(1).first().samples
    assert augment.mix_pairs(df.limit(0)).count() == 0


def test_weighted_sample(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0.1, 0.2, 0.0, 0.7, None])], "event_id long, w double")
    got = [r.event_id for r in balance.weighted_sample(df, "w", 4000, "event_id").collect()]
    assert len(got) == 4000 and set(got) == {0, 1, 3}
    assert abs(got.count(3) / 4000 - 0.7) < 0.04 and abs(got.count(0) / 4000 - 0.1) < 0.03
    assert balance.weighted_sample(df.where("w = 0"), "w", 10, "event_id").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "list.csv").write_text('n,code\n1,"a,b"\n2, c \n3,"say ""x"""\n')
    assert [(r.label_id, r.code) for r in io.read_code_list(spark, str(tmp_path / "list.csv"), "code").orderBy("label_id").collect()] == [(0, "a,b"), (1, "c"), (2, 'say "x"')]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "n.wav").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in io.list_noise_files(spark, str(tmp_path / "deep")).collect()] == ["n.wav"]


def test_short_recordings_together():
    """Recordings of one size are clustered at once, as one by one."""
    rnd = np.random.default_rng(3)
    parts = [rnd.integers(0, 5, (n, 2)).astype(float) if n % 2 else rnd.normal(size=(n, 2)) for n in rnd.integers(1, 12, 300).tolist() + [70, 64]]
    first = np.cumsum([0] + [len(p) for p in parts[:-1]])
    for eps, pct in (("auto", 5.0), (1.0, 5.0), (1.0, 60.0)):
        got, plain = cluster._each(np.concatenate(parts), first, eps, pct), [cluster._one(p, eps, pct) for p in parts]
        assert all((a == np.concatenate(b)).all() for a, b in zip(got, zip(*plain), strict=True))
